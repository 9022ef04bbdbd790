"""Packing by powers of two: documents are split into pieces of binary lengths.

A document of n ids gives n // 4096 pieces of 4096 ids and one piece for each bit
that is set in the rest, long pieces first. A piece is a sequence of its own, of
its own length, so no sequence crosses documents and none is padded. Pieces of
equal length are written together (one folder a length), so a batch drawn from
one folder has one shape.

Defined results: a null or empty text is the end id alone, one piece of length 1;
repeated rows are packed one by one; a null ``doc_id`` stays null; an empty table
gives no pieces. Further input columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, shared_folder, slices, table
from .tokens import encoder

MOST, END = 4096, 2


def cuts(n: int, most: int = MOST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; ``most`` is a power of two."""
    out = [(k, most) for k in range(0, n - n % most, most)]
    at, rest = n - n % most, n % most
    while rest:
        length = 1 << (rest.bit_length() - 1)
        out.append((at, length))
        at, rest = at + length, rest - length
    return out


def packed(docs: DataFrame, vocabulary: str, most: int = MOST, end: int = END, cut: str = "dropped") -> DataFrame:
    """One row a piece: its document, place, ids (packed unsigned 32-bit) and sequence.

    ``docs`` has ``doc_id`` and ``text``. The rows are read from the files written
    here, so what is returned is what a trainer would read.
    """
    if most & (most - 1):
        raise ValueError("the longest piece must be a power of two")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary, cut)
        for batch in slices(batches, "text", 4 << 20):
            ids = model.encode(batch.column("text").to_pylist(), end)
            rows, starts, lengths, data, totals = [], [], [], [], []
            for k, blob in enumerate(ids):
                n = len(blob) // 4
                for start, length in cuts(n, most):
                    rows.append(k)
                    starts.append(start)
                    lengths.append(length)
                    totals.append(n)
                    data.append(blob[4 * start:4 * (start + length)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(data, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "ids"])

    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary"
    path = shared_folder(spark, "packed")
    numbered = source.mapInArrow(pieces, schema).withColumn("sequence_id", F.monotonically_increasing_id())
    numbered.write.partitionBy("length").option("compression", "zstd").parquet(path)
    fields = f"doc_id {kind}, start long, doc_tokens long, ids binary, sequence_id long, length long"
    return spark.read.schema(fields).parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The columns that the query and the pipeline return."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        F.lit(0).cast("long").alias("offset"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of binary lengths, no padding."""
    import public_tokenizers

    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return digest(packed(docs, public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op10_packing": op10_packing}
SQL: dict[str, str] = {}
