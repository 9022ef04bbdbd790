"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes that are none of these; ``bytes.split()`` splits at the same six.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name where the driver and all executors can read and write.

    The cluster names the root in ``spark.checkpoint.dir``. Where it is unset, as
    in tests, the warehouse is the root.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """True if something lies at ``path``, in whatever store Spark finds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Steps that several later ones read are computed once, and an executor that
    is lost takes nothing of them with it.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_training_part(doc_id: str = "doc_id") -> Column:
    """True for the rows that a model may learn from: crc32 of the id's text mod 5 is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``column`` holds about ``most_bytes``, one row at least.

    Every row comes out once and in order; only the working memory depends on the bound.
    """
    for batch in batches:
        at, column_no = 0, batch.schema.get_field_index(column)
        while at < batch.num_rows:
            n = batch.num_rows - at
            while n > 1 and span(batch.column(column_no), at, n) > most_bytes:
                n //= 2
            yield batch.slice(at, n)
            at += n


def span(column: pa.Array, at: int, n: int) -> int:
    """Bytes that ``n`` rows of a string or binary column hold from row ``at``."""
    if len(column) == 0 or column.buffers()[1] is None:
        return 0
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = memoryview(column.buffers()[1]).cast("q" if wide else "i")
    first = column.offset + at
    return offsets[first + n] - offsets[first]


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for; it follows the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of any name stay out of an operator's way."""
    return df.select(*[F.col(c) for c in columns])
