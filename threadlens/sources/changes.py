"""Change feeds and folder trees to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlens.schemas import CHANGES
from threadlens.session import materialise
from threadlens.sources.providers import readable

# Fixed values -----------------------------------------------------------
DELTA_PAGE = """
    value array<struct<id: string, conversationId: string, `@removed`: string>>
"""
_TOUCH = "array<struct<message: struct<id: string, threadId: string>>>"
HISTORY_PAGE = (
    f"history array<struct<messagesAdded: {_TOUCH}, labelsAdded: {_TOUCH}, "
    f"labelsRemoved: {_TOUCH}, messagesDeleted: {_TOUCH}>>"
)
# ------------------------------------------------------------------------


def read_changes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Change rows from a folder of Parquet files, as a batch or a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(CHANGES).parquet(path)


def delta_to_changes(raw: DataFrame) -> DataFrame:
    """``raw(user_id, source_id, payload, seq)``: folder delta pages to change rows."""
    item = raw.select(
        "user_id", "source_id", "seq",
        F.explode(readable(F.col("payload"), DELTA_PAGE)["value"]).alias("i"),
    )
    removed = F.col("i.@removed").isNotNull()
    return item.filter(F.coalesce("i.id", F.lit("")) != "").select(
        "user_id", "source_id",
        F.when(~removed, F.nullif(F.col("i.conversationId"), F.lit(""))).alias("thread_id"),
        F.when(removed, F.col("i.id")).alias("removed_message_id"), "seq",
    ).filter("thread_id is not null or removed_message_id is not null")


def history_to_changes(raw: DataFrame) -> DataFrame:
    """``raw(user_id, payload, seq)``: history pages to distinct change rows.

    Added messages and label changes touch a thread, deletions name a message.
    """
    h = raw.select("user_id", "seq", F.explode(readable(F.col("payload"), HISTORY_PAGE)["history"]).alias("h"))
    none = F.array().cast(_TOUCH)
    touches = F.concat(*[
        F.coalesce(f"h.{k}", none) for k in ("messagesAdded", "labelsAdded", "labelsRemoved")
    ])
    touched = h.select("user_id", "seq", F.explode(touches).alias("t")).select(
        "user_id", "seq", F.col("t.message.threadId").alias("thread_id")
    )
    deleted = h.select("user_id", "seq", F.explode("h.messagesDeleted").alias("d")).select(
        "user_id", "seq", F.col("d.message.id").alias("removed_message_id")
    )
    rows = touched.withColumn("removed_message_id", F.lit(None).cast("string")).unionByName(
        deleted.withColumn("thread_id", F.lit(None).cast("string"))
    )
    return (
        rows.filter("coalesce(thread_id, '') <> '' or coalesce(removed_message_id, '') <> ''")
        .groupBy("user_id", "thread_id", "removed_message_id")
        .agg(F.max("seq").alias("seq"))
        .select("user_id", F.lit("mailbox").alias("source_id"), "thread_id", "removed_message_id", "seq")
    )


def full_changes(messages: DataFrame, scope=None) -> DataFrame:
    """A full enumeration: every thread of the mailbox (or of ``scope``) once.

    Take the high-water mark with :func:`high_water` first, so that mail which
    arrives during the listing is reported again instead of lost.
    """
    rows = messages if scope is None else messages.filter(scope)
    return rows.groupBy("user_id", "thread_id").agg(F.max("arrival_seq").alias("seq")).select(
        "user_id", F.lit("mailbox").alias("source_id"), "thread_id",
        F.lit(None).cast("string").alias("removed_message_id"), "seq",
        F.lit(True).alias("did_full_resync"),
    )


def high_water(messages: DataFrame) -> DataFrame:
    return messages.groupBy("user_id").agg(F.max("arrival_seq").alias("seq"))


def folder_tree(folders: DataFrame, excluded: DataFrame) -> DataFrame:
    """Folders reachable from the roots without passing an excluded folder.

    ``folders(user_id, folder_id, parent_id, name)``; roots have no parent. One
    join per level, as deep as the folders go.
    """
    keys = ["user_id", "folder_id"]
    allowed = materialise(folders.join(excluded.select(*keys).distinct(), keys, "left_anti"), "folders")
    level = allowed.filter("parent_id IS NULL").select(*keys, "name", F.lit(0).alias("depth"))
    out = None
    while True:
        level = materialise(level, "level")
        if level.isEmpty() and out is not None:
            return out
        out = level if out is None else out.unionByName(level)
        above = level.select("user_id", F.col("folder_id").alias("parent_id"), F.col("depth").alias("above"))
        level = allowed.join(above, ["user_id", "parent_id"]).select(
            *keys, "name", (F.col("above") + 1).alias("depth"))
