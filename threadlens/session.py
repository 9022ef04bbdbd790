"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession, functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Files and texts reach Python in batches of bounded size.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    # Searches push their tokens to the index scan as one IN list.
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
}


def builder(app: str = "threadlens") -> SparkSession.Builder:
    """A session builder with the settings the jobs rely on (UTC, AQE)."""
    b = SparkSession.builder.appName(app)
    for key, value in DEFAULTS.items():
        b = b.config(key, value)
    return b


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the run folder, which driver and executors share."""
    return os.path.join(run_folder(spark), f"{name}-{uuid.uuid4().hex}")


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables.

    The cluster names the root in ``spark.checkpoint.dir``; where that is unset,
    the warehouse is the root.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(root, "threadlens", spark.sparkContext.applicationId)


def drop_run(spark: SparkSession) -> None:
    """Remove the run folder, once no result that reads from it is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df, name: str):
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of results that several later steps read, so they are
    computed once and survive the loss of executors.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df, *keys: str):
    """Hash ``df`` over the session's shuffle partitions before costly expansions.

    For steps that turn a few bytes of input into much work, where partitions
    sized by bytes would be too few.
    """
    conf = df.sparkSession.conf
    return df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys)


def parts_of(df, each: int = 8 << 20) -> int:
    """How many partitions of about ``each`` stored bytes the files behind ``df`` make, one per core at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // each))


def rows_of(df, *keep: str, name: str, lists: str):
    """``df`` with one row per element of its column ``lists``, whose elements are never null.

    A plain ``explode`` makes Spark test the size of the list first, which computes the list
    once more, before any shuffle.
    """
    return df.select(*keep, F.explode_outer(lists).alias(name)).filter(F.col(name).isNotNull())


def by_key(df, keys: list[str], parts: int | None = None):
    """Hash ``df`` by ``keys``: over ``parts`` partitions, or as many as the session finds fit."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


#: Keys below this number are few enough for Spark to broadcast them; bits of a filter for each of
#: more keys, and the most bits of a filter (32 MB).
FEW_KEYS, BITS_A_KEY, MOST_BITS = 100_000, 16, 1 << 28


def among(df, keys, on: list[str], few: int = FEW_KEYS):
    """The rows of ``df`` whose ``on`` is among ``keys``, which hold each key once and are read twice.

    Where the keys are too many to broadcast, a semi-join shuffles all of ``df``. A bitmap
    of hashed keys is broadcast instead and drops most other rows before the exact join:
    one in sixteen passes it, more only beyond ``MOST_BITS``.
    """
    n = keys.count()
    if n <= few:
        return df.join(keys.select(*on), on, "left_semi")
    bits = min(MOST_BITS, max(1 << 15, 1 << (n * BITS_A_KEY - 1).bit_length()))
    at = F.pmod(F.xxhash64(*on), F.lit(bits))
    page, place = F.shiftright(at, 15).alias("_page"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("_place")
    pages = keys.select(page, place).groupBy("_page").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.expr("substring(_bits, CAST(_place DIV 8 AS INT) + 1, 1)")
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.col("_place") % 8) == 1
    likely = df.withColumns({"_page": page, "_place": place}).join(
        F.broadcast(pages), "_page").filter(held).drop("_page", "_place", "_bits")
    # Not a semi-join, which Spark would move below the filter.
    return likely.join(keys.select(*on), on)


def spread_if_small(df, *keys: str, below: int = 1 << 30):
    """:func:`spread` for inputs of few row groups; larger scans split themselves."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return spread(df, *keys) if int(str(size)) < below else df
