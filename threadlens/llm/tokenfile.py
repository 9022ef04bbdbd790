"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames, each with a content checksum and
holding whole documents, then a skippable frame with the directory of documents
and a skippable frame with the seek table (frame sizes, and a checksum of each
frame's content: the low 32 bits of its XXH64), which ends in a footer of nine
bytes. Any zstandard tool decompresses such a file; a reader that wants some
documents reads the tail and then only the frames that hold them.

Defined results: a null or empty text is the end id alone; rows of equal
``doc_id`` are all kept, in the order of their texts' hashes; null ids come first
and stay null; an empty table gives no file and no rows. Further columns are
left out.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, partitions, shared_folder, slices, table
from .tokens import encoder

# Fixed values of the seekable zstandard format.
SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
SKIPPABLE = 0x184D2A50
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
WITH_CHECKSUMS = 0x80

FRAME_BYTES, END = 256 << 10, 2


def filesystem(path: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file; documents are never divided between frames."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self._out, self._bound = out, frame_bytes
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._pending: list[bytes] = []
        self._pending_bytes = 0
        self._frames: list[tuple[int, int, int]] = []
        self._docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self._pending and self._pending_bytes + len(ids) > self._bound:
            self._flush()
        self._pending.append(ids)
        self._pending_bytes += len(ids)
        self._docs.append((0 if doc_id is None else doc_id, doc_id is not None, len(ids)))

    def _flush(self) -> None:
        import xxhash

        content = b"".join(self._pending)
        frame = self._zstd.compress(content)
        self._out.write(frame)
        self._frames.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self._pending, self._pending_bytes = [], 0

    def close(self) -> None:
        if self._pending:
            self._flush()
        ids, known, sizes = zip(*self._docs, strict=True) if self._docs else ((), (), ())
        directory = np.array(ids, "<i8").tobytes() + np.array(sizes, "<u8").tobytes() + np.array(known, "u1").tobytes()
        self._out.write(struct.pack("<II", SKIPPABLE, len(directory)) + directory)
        entries = b"".join(ENTRY.pack(*f) for f in self._frames)
        table_bytes = entries + FOOTER.pack(len(self._frames), WITH_CHECKSUMS, FOOTER_MAGIC)
        self._out.write(struct.pack("<II", SEEK_MAGIC, len(table_bytes)) + table_bytes)
        self._out.close()


class Reader:
    """Random access to the documents of one file (a seekable binary file object)."""

    def __init__(self, source):
        import zstandard

        self._source, self._zstd = source, zstandard.ZstdDecompressor()
        self._size = source.seek(0, 2)
        n_frames, flags, magic = FOOTER.unpack(self._at(self._size - FOOTER.size, FOOTER.size))
        if magic != FOOTER_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        seek_start = self._size - FOOTER.size - n_frames * ENTRY.size
        self.frames = np.frombuffer(self._at(seek_start, n_frames * ENTRY.size), "<u4").reshape(n_frames, 3).astype(np.int64)
        self._frame_at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        content = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        magic, length = struct.unpack("<II", self._at(int(self._frame_at[-1]), 8))
        if magic != SKIPPABLE:
            raise ValueError("no directory of documents")
        directory, n = self._at(int(self._frame_at[-1]) + 8, length), length // 17
        ids, known = np.frombuffer(directory, "<i8", n), np.frombuffer(directory, "u1", n, 16 * n)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self._doc_at = np.concatenate([[0], np.cumsum(np.frombuffer(directory, "<u8", n, 8 * n).astype(np.int64))])
        self.frame_of = np.searchsorted(content, self._doc_at[:-1], "right") - 1
        self._content, self.decompressed = content, 0

    def _at(self, start: int, length: int) -> bytes:
        self._source.seek(start)
        return self._source.read(length)

    def frame(self, k: int) -> bytes:
        """The content of frame ``k``; a wrong checksum is an error."""
        import xxhash

        packed, size, checksum = self.frames[k]
        content = self._zstd.decompress(self._at(int(self._frame_at[k]), int(packed)), max_output_size=int(size))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k}: wrong checksum")
        self.decompressed += 1
        return content

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int, int | None, bytes]]:
        """(row, doc_id, packed ids) of the given rows or all; each needed frame is read once if rows ascend."""
        last, content = -1, b""
        for r in range(len(self.doc_ids)) if rows is None else rows:
            if (k := int(self.frame_of[r])) != last:
                last, content = k, self.frame(k)
            start = int(self._doc_at[r] - self._content[k])
            yield r, self.doc_ids[r], content[start:start + int(self._doc_at[r + 1] - self._doc_at[r])]


def write(docs: DataFrame, vocabulary: str, end: int = END, cut: str = "leading") -> DataFrame:
    """Writes all documents in ascending ``doc_id`` order; one row a file: place in order, path, ids in it.

    A file holds one range of ids. Files of failed or repeated attempts are not in
    the manifest, which Spark commits with the task that wrote them.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, writer, total, path = encoder(vocabulary, cut), None, 0, ""
        for batch in slices(batches, "text", 4 << 20):
            if batch.num_rows and writer is None:
                path = f"{folder}/tokens-{uuid.uuid4().hex}.zst"
                fs, place = filesystem(path)
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                writer = Writer(fs.open_output_stream(place, compression=None))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), model.encode(batch.column("text").to_pylist(), end), strict=True):
                writer.add(doc_id, ids)
                total += len(ids) // 4
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [path], "n": [total]})

    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_tie"))
    ordered = source.repartitionByRange(partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")
    manifest = ordered.select("doc_id", "text").mapInArrow(files, "part long, path string, n long")
    out = f"{folder}/manifest"
    manifest.write.parquet(out)
    return spark.read.schema("part long, path string, n long").parquet(out)


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id, start, ids``; ``start`` counts the ids before it in all files."""
    spark = manifest.sparkSession

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, place = filesystem(path)
                with fs.open_input_file(place) as source:
                    rows, at, size = [], base, 0
                    for _, doc_id, ids in Reader(source).documents():
                        rows.append((doc_id, at, ids))
                        at, size = at + len(ids) // 4, size + len(ids)
                        if size > 8 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    spread = placed.select("path", "base").repartition(partitions(spark))
    return spread.mapInArrow(documents, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "ids"])


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written, read back and digested."""
    import public_tokenizers

    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    back = read(write(docs, public_tokenizers.path("byte_bpe_50k.json")))
    return back.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op5_token_file": op5_token_file}
SQL: dict[str, str] = {}
