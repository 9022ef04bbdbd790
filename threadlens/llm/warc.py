"""WARC archives of captures, and one index over all of them.

Each task writes its captures to archive files (one gzip member a record) and
keeps an index run per file, sorted by URL key, time and id. The runs are then
merged outside memory's reach of any single task: Spark deals them by ranges of
the key, so that each task holds the matching stretch of every run and merges the
stretches with a loser tree. The result is the capture history of every URL in
one global order; records are read back through it.

Of captures with equal payloads the one with the largest id is written as
``response``, others as ``revisit`` records that refer to it and carry no payload.

Defined results: a null payload is empty; a null or odd URL has the key it can
have (null: empty); captures that repeat id and payload of a response are
responses too; null ids count as smallest and, alone, are responses; equal keys
and times are ordered by id, file and offset; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, partitions, shared_folder, slices, stored, table

#: A file is closed after so many compressed bytes.
FILE_BYTES = 64 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_authority = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)")


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels reversed, then path and query; no fragment."""
    m = _authority.match(url or "")
    if not m:
        return (url or "").split("#", 1)[0]
    labels = m[1].lower().removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (m[2] or "/")


def record_urn(page_id: int | None) -> str:
    """A version 8 UUID that holds the id, so that records can be traced back."""
    value = (1 << 120) if page_id is None else (page_id & (2**64 - 1))
    high, low = value >> 62, value & (2**62 - 1)
    n = (high >> 12 << 80) | (8 << 76) | ((high & 0xFFF) << 64) | (2 << 62) | low
    return f"<urn:uuid:{uuid.UUID(int=n)}>"


def page_id_of(urn: str) -> int | None:
    n = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    value = ((n >> 80 << 12 | n >> 64 & 0xFFF) << 62) | (n & (2**62 - 1))
    if value >> 120:
        return None
    return value - 2**64 if value >= 2**63 else value


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id, url, when: int, payload: bytes, refers_to, revisit: bool, digest: str | None = None) -> bytes:
    """One record, compressed as a gzip member of its own."""
    date = datetime.fromtimestamp(when, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "" if url is None else "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url) + "\r\n"
    refers = f"WARC-Refers-To: {record_urn(refers_to)}\r\nWARC-Profile: {_REVISIT}\r\n" if revisit else ""
    head = (
        f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: {record_urn(page_id)}\r\n"
        f"WARC-Date: {date}\r\n{target}WARC-Payload-Digest: sha1:{digest or payload_digest(payload)}\r\n{refers}"
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> dict:
    """What a record says, its digest checked against the payload that it carries."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": page_id_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "date": fields["WARC-Date"],
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": page_id_of(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload}


class LoserTree:
    """Merges sorted runs: each step replays one leaf's path, one comparison a level."""

    def __init__(self, runs: list[list]):
        self._runs = [iter(r) for r in runs]
        self._head = [next(r, None) for r in self._runs]
        n = max(1, len(runs))
        self._losers = [-1] * n
        self._winner = -1
        for leaf in range(len(runs)):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self._head[a], self._head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, leaf: int) -> None:
        node, winner = (leaf + len(self._losers)) // 2, leaf
        while node:
            other = self._losers[node]
            if other < 0:  # still building: wait here for the other side
                self._losers[node] = winner
                return
            if self._before(other, winner):
                self._losers[node], winner = winner, other
            node //= 2
        self._winner = winner

    def __iter__(self) -> Iterator:
        while self._winner >= 0 and self._head[self._winner] is not None:
            leaf = self._winner
            yield self._head[leaf]
            self._head[leaf] = next(self._runs[leaf], None)
            self._replay(leaf)


_RUNS = "url_key string, captured long, page_id long, file string, offset long, length long"
_RUN_ARROW = pa.schema([("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()),
                        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _order(entry: tuple) -> tuple:
    key, when, page, *place = entry
    return (key, when, page is not None, page or 0, *place)


def written(pages: DataFrame, captured: Column, page_id: str = "page_id", url: str = "url", html: str = "html",
            least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives; the sorted index runs, one for each file.

    ``captured`` is the time of a capture in seconds. Payloads below ``least_bytes``
    are always written whole.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), captured.cast("long").alias("captured"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    # Only payloads that occur more than once need a look-up.
    repeats = rows.groupBy("sha", "bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).where(
        (F.col("c") > 1) & (F.col("bytes") >= least_bytes)).drop("c")
    rows = rows.join(repeats, ["sha", "bytes"], "left")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokenfile import filesystem

        out, run, at, name = None, [], 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            run.sort(key=_order)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run, strict=True), _RUN_ARROW)], schema=_RUN_ARROW)

        for batch in slices(batches, "html"):
            for p, u, when, text, last, sha in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "captured", "html", "last", "sha")], strict=True):
                if out is None:
                    name = f"{folder}/capture-{uuid.uuid4().hex}.warc.gz"
                    fs, place = filesystem(name)
                    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out, run, at = fs.open_output_stream(place, compression=None), [], 0
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                member = record(p, u, when or 0, text.encode(), last, last is not None and p != last, digest)
                out.write(member)
                run.append((url_key(u), when or 0, p, name, at, len(member)))
                at += len(member)
                if at >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return stored(rows.select("page_id", "url", "captured", "html", "last", "sha").mapInArrow(files, _RUNS), "runs")


def merged(runs: DataFrame) -> DataFrame:
    """All runs as one index in the order of key, time and id, with the global ``position``."""
    spark = runs.sparkSession

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own: dict[str, list] = {}
        for batch in batches:
            for entry in zip(*[batch.column(f.name).to_pylist() for f in _RUN_ARROW], strict=True):
                own.setdefault(entry[3], []).append(_order(entry))
        stretches = []
        for name in sorted(own):
            # A run's stretch may arrive in several sorted pieces.
            piece: list = []
            for e in own[name]:
                if piece and e < piece[-1]:
                    stretches.append(piece)
                    piece = []
                piece.append(e)
            stretches.append(piece)
        part, block, k = TaskContext.get().partitionId(), [], 0
        for e in LoserTree(stretches):
            block.append((part, k, e[0], e[1], e[3] if e[2] else None, *e[4:]))
            k += 1
            if len(block) == 10_000:
                yield rows(block)
                block = []
        if block:
            yield rows(block)

    schema = pa.schema([("part", pa.int64()), ("k", pa.int64()), *_RUN_ARROW])
    rows = lambda b: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*b, strict=True), schema)], schema=schema)
    ranged = runs.repartitionByRange(partitions(spark), "url_key", "captured", "page_id", "file", "offset")
    index = stored(ranged.mapInArrow(merge, f"part long, k long, {_RUNS}"), "index")
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = index.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "part").withColumn("position", F.col("base") + F.col("k")).drop("part", "k", "base")


_READ = ("position long, url_key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The record of every index entry, from the archive files; with ``payloads`` their content."""
    spark = index.sparkSession
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokenfile import filesystem

        source, name = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = []
                for file, offset, length in zip(*[part.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True):
                    if file != name:
                        fs, place = filesystem(file)
                        source, name = fs.open_input_file(place), file
                    source.seek(offset)
                    got.append(parsed(source.read(length)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("position"), part.column("url_key"), *[pa.array([g[c] for g in got], k) for c, k in zip(columns, kinds, strict=True)]],
                    names=["position", "url_key", *columns])

    by_file = index.select("position", "url_key", "file", "offset", "length").repartitionByRange(
        partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    return by_file.mapInArrow(fetch, _READ + ", payload binary" * payloads)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an archived record, found through the merged index and read back.

    The table has no capture times: a page is captured ``page_id`` seconds into 2024.
    """
    pages = only(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    captured = F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31536000))
    return read(merged(written(pages, captured))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc": op2_warc}
SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS sha,
    max(page_id) OVER (PARTITION BY sha1(html), strlen(html)) AS last,
    count(*) OVER (PARTITION BY sha1(html), strlen(html)) AS c
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(sha, (5 * (j // 4) + 1)::INT, 5))::INT >> (15 - 5 * (j % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN c > 1 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN c > 1 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d""",
}
