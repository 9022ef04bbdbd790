"""Latest state of running jobs, tag batches and snapshots from event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlens.functions.values import expired

# Fixed values -----------------------------------------------------------
ACTIVE_STATUSES = [
    "checking folders", "indexing threads", "updating threads", "reading attachments",
    "downloading attachments", "processing", "tagging", "tagging (batch)", "retagging",
]
STALE_AFTER_SECONDS = 300
PROGRESS_KEYS = ["progress_current", "progress_total", "progress_status", "progress_updated"]
# ------------------------------------------------------------------------


def latest_state(events: DataFrame) -> DataFrame:
    """Latest value of each progress key per user, as columns with defaults."""
    value = {
        k: F.max_by("value", F.when(F.col("key") == k, F.col("seq"))) for k in PROGRESS_KEYS
    }
    wide = events.filter(F.col("key").isin(PROGRESS_KEYS)).groupBy("user_id").agg(
        *[v.alias(k) for k, v in value.items()]
    )
    whole = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint"))
    return wide.select(
        "user_id", whole("progress_current").alias("current"),
        whole("progress_total").alias("total"),
        F.coalesce("progress_status", F.lit("idle")).alias("status"),
        F.col("progress_updated").try_cast("double").alias("updated"),
    )


def is_active(status: Column) -> Column:
    return status.isin(ACTIVE_STATUSES)


def stale(state: DataFrame, now_epoch: float, after: int = STALE_AFTER_SECONDS) -> DataFrame:
    """Active users whose heartbeat is older than ``after`` seconds (strictly)."""
    age = F.coalesce(F.lit(float(now_epoch)) - F.col("updated"), F.lit(float("inf")))
    return state.withColumn("stale", is_active(F.col("status")) & (age > after))


def interrupt(state: DataFrame) -> DataFrame:
    """At start nothing can be running: active becomes interrupted."""
    active = is_active(F.col("status"))
    return state.withColumns({
        "was_active": active,
        "status": F.when(active, "interrupted").otherwise(F.col("status")),
    })


def progress(state: DataFrame, elapsed_seconds: Column) -> DataFrame:
    """Percent done and seconds left at the present rate (null when unknown)."""
    total, current = F.nullif(F.col("total"), F.lit(0)), F.nullif(F.col("current"), F.lit(0))
    left = (F.col("total") - F.col("current")) * elapsed_seconds / current
    return state.withColumns({
        "percent": F.floor(F.col("current") * 100.0 / total + 0.5).cast("bigint"),
        "seconds_left": F.when(total.isNotNull(), F.floor(left + 0.5).cast("bigint")),
    })


def open_batches(events: DataFrame, now: Column) -> DataFrame:
    """Tag batches still to be collected.

    A batch is open from submission until it ended. One that cannot be read is
    kept until its record is past its lifetime.
    """
    last = events.groupBy("user_id", "batch_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.min_by("submitted_at", "seq").alias("submitted_at"),
    )
    gone = (F.col("status") == "unknown") & expired(F.col("submitted_at"), now)
    return last.filter((F.col("status") != "ended") & ~gone)


def users_with_batches(open_rows: DataFrame) -> DataFrame:
    return open_rows.select("user_id").distinct()


# Snapshots -------------------------------------------------------------------

def retire(versions: DataFrame, keep: int) -> DataFrame:
    """Versions beyond the newest ``keep`` of each set."""
    rank = Window.partitionBy("set_id").orderBy(F.col("taken").desc(), F.col("version").desc())
    newest = versions.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= keep)
    return versions.join(newest.select("set_id", "version"), ["set_id", "version"], "left_anti")


def snapshot_due(versions: DataFrame, hours: float, now: Column) -> DataFrame:
    """Per set: age of the newest version and whether a new one is due."""
    newest = versions.groupBy("set_id").agg(F.max("taken").alias("newest"))
    age = (F.unix_micros(now) - F.unix_micros("newest")) / F.lit(1e6)
    due = F.lit(False) if hours <= 0 else F.coalesce(age >= hours * 3600, F.lit(True))
    return newest.select("set_id", F.greatest(age, F.lit(0.0)).alias("age_seconds"), due.alias("due"))
