"""Usage counters, cost and spend."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadlens.functions.values import cost
from threadlens.operators.tagging import untagged

DAY_KEY = ["user_id", "day", "batched"]


def usage_daily(events: DataFrame) -> DataFrame:
    """Counters per user, day and kind of request."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    if "ts" in events.columns:  # events that do not name their day
        own = F.date_format("ts", "yyyy-MM-dd")
        events = events.withColumn("day", F.coalesce(F.nullif("day", F.lit("")), own))
    return events.groupBy(*DAY_KEY).agg(
        F.count("*").alias("requests"),
        F.sum(zero("input_tokens")).alias("input_tokens"),
        F.sum(zero("output_tokens")).alias("output_tokens"),
        F.sum(zero("cache_read_tokens")).alias("cache_read_tokens"),
    )


def _totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("user_id").agg(
        F.sum("requests").alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.when(F.col("batched"), F.col("requests")).otherwise(0)).alias("batched_requests"),
    )


def usage_by_user(daily: DataFrame, users: DataFrame) -> DataFrame:
    """Totals of users that still exist, with their cost."""
    return _totals(daily).join(users.select("user_id", "email"), "user_id").withColumn(
        "cost", _cost()
    )


def usage_since(daily: DataFrame, day: str) -> DataFrame:
    """Totals from ``day`` on, inclusive."""
    return _totals(daily.filter(F.col("day") >= day))


def _cost():
    return cost(
        F.col("requests"), F.col("batched_requests"), F.col("input_tokens"), F.col("output_tokens")
    )


def spend_status(
    daily: DataFrame, users: DataFrame, month_first: str, limit: float | None, admins: list[str]
) -> DataFrame:
    """Spend since ``month_first`` per user, and whether it reached the limit."""
    spent = usage_since(daily, month_first).withColumn("spent", _cost())
    rows = users.select("user_id", "email").join(spent.select("user_id", "spent"), "user_id", "left")
    amount = F.coalesce("spent", F.lit(0.0))
    is_admin = F.lower("email").isin([a.lower() for a in admins])
    over = F.lit(False) if limit is None else (amount >= limit) & ~is_admin
    return rows.select("user_id", "email", amount.alias("spent"), over.alias("over_limit"))


def untagged_by_user(threads: DataFrame, users: DataFrame) -> DataFrame:
    """Users with untagged threads, most first; unknown users show their id."""
    counts = untagged(threads).groupBy("user_id").agg(F.count("*").alias("untagged"))
    return (
        counts.join(users.select("user_id", "email"), "user_id", "left")
        .select("user_id", F.coalesce("email", "user_id").alias("email"), "untagged")
        .orderBy(F.col("untagged").desc(), "user_id")
    )


def counts(threads: DataFrame) -> DataFrame:
    """Threads and untagged threads per user."""
    empty = F.col("ai_tags").isNull() | (F.size("ai_tags") == 0)
    return threads.groupBy("user_id").agg(
        F.count("*").alias("threads"), F.count_if(empty).alias("untagged")
    )


def describe_counts(threads: DataFrame, users: DataFrame) -> DataFrame:
    """One row: threads, tagged threads, users."""
    is_tagged = F.col("ai_tags").isNotNull() & (F.size("ai_tags") > 0)
    marks = threads.select(F.lit("thread").alias("kind"), is_tagged.alias("tagged")).unionByName(
        users.select(F.lit("user").alias("kind"), F.lit(False).alias("tagged"))
    )
    return marks.agg(
        F.count_if(F.col("kind") == "thread").alias("threads"),
        F.count_if("tagged").alias("tagged"),
        F.count_if(F.col("kind") == "user").alias("users"),
    )
