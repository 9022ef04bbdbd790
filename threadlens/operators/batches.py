"""Collecting tag batches that an earlier run submitted.

A batch is open until it is collected (its provider has ended it) or expired (it
cannot be read and its record is past its lifetime); until then it is kept. Tags and
usage of a collected batch are written under its own id, replacing what an attempt
that failed left there, and the ledger is written last. So a batch that is collected
again, or whose collection died half way, counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from threadlens.functions.values import expired
from threadlens.operators.tagging import join_replies, remainder
from threadlens.schemas import KEY
from threadlens.session import materialise, spread

BATCH = ["user_id", "batch_id"]
TABLES = {
    "tags": "user_id string, thread_id string, group_id string, tags array<string>, truncated boolean, batch_id string",
    "usage": """user_id string, requests bigint, input_tokens bigint, output_tokens bigint,
                cache_read_tokens bigint, batch_id string""",
    "left": "user_id string, thread_id string, batch_id string",
    "ledger": "user_id string, state string, batch_id string",
}


def transitions(batches: DataFrame, now: Column) -> DataFrame:
    """``batches(user_id, batch_id, status, submitted_at)`` with the ``state`` each moves to."""
    gone = (F.col("status") == "unknown") & expired(F.col("submitted_at"), now)
    return batches.withColumn(
        "state", F.when(F.col("status") == "ended", "collected").when(gone, "expired").otherwise("kept"))


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One of the tables below ``root``; ``left`` are threads of collected batches that no reply covered."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    schema = T.StructType.fromDDL(TABLES[table])
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{table}")


def _write(df: DataFrame, root: str, table: str) -> None:
    """Replace the folders of the batches in ``df``.

    Rows are dealt by batch, so that a batch is one file and not one of each task. Their
    bytes are few and their folders many, so tasks are not merged by size.
    """
    names = [f.name for f in T.StructType.fromDDL(TABLES[table]).fields]
    spread(df.select(*names), "batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "batch_id").parquet(f"{root}/{table}")


def collect(batches: DataFrame, mapping: DataFrame, replies: DataFrame, now: Column, root: str) -> DataFrame:
    """Move open batches on; returns (user_id, batch_id, status, state) of those that were open.

    ``mapping(user_id, batch_id, group_id, pos, thread_id)`` says who is where in a
    batch, ``replies(batch_id, group_id, status, reply, input_tokens, output_tokens,
    cache_read_tokens)`` what came back. Batch ids are the provider's and name one user.
    """
    spark = batches.sparkSession
    closed = read(spark, root, "ledger").select(*BATCH)
    moved = materialise(transitions(
        batches.select(*BATCH, "status", "submitted_at").join(closed, BATCH, "left_anti"), now), "transitions")
    ended = moved.filter("state = 'collected'").select(*BATCH)
    places = mapping.join(ended, BATCH, "left_semi")
    answers = replies.join(ended.select("batch_id"), "batch_id", "left_semi")
    tags = materialise(join_replies(places, answers), "collected")
    _write(tags, root, "tags")
    _write(remainder(places, tags), root, "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(0).cast("bigint"))).alias(c)
    _write(answers.filter("status = 'succeeded'").join(ended, "batch_id").groupBy(*BATCH).agg(
        F.count("*").alias("requests"), count("input_tokens"), count("output_tokens"), count("cache_read_tokens")),
        root, "usage")
    _write(moved.filter("state <> 'kept'"), root, "ledger")
    return moved
