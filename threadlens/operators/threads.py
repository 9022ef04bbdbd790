"""Messages to threads: headers, child tables and body text.

Everything a thread header needs is a mergeable aggregate, so it is combined
before the shuffle. Only the body text needs an order, and only its first
``limit`` characters: each salt slice of a thread keeps the prefix that can
still reach the cap, and those bounded prefixes meet in one small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlens.functions.text import TEXT_CAP, message_text
from threadlens.functions.values import message_day
from threadlens.schemas import KEY

SALTS = 32
ORDER = ["date", "arrival_seq", "message_id"]


def drop_containers(messages: DataFrame, excluded: list[str]) -> DataFrame:
    """Messages outside the excluded folders or labels (fixed short list)."""
    return messages.filter(~F.coalesce("container_id", F.lit("")).isin(excluded))


def first_copies(messages: DataFrame) -> DataFrame:
    """One row per message id of a thread: the first to arrive.

    Copies without an arrival number come last; equal numbers are settled by
    the content, so a retried task keeps the same copy.
    """
    rest = [c for c in messages.columns if c not in (*KEY, "message_id", "arrival_seq")]
    copy = F.struct(F.col("arrival_seq").isNull().alias("late"), "arrival_seq", *rest)
    return (
        messages.groupBy(*KEY, "message_id").agg(F.min(copy).alias("m"))
        .select(*KEY, "message_id", *[F.col(f"m.{c}").alias(c) for c in ("arrival_seq", *rest)])
    )


def _dated(messages: DataFrame) -> DataFrame:
    return messages.withColumn("date", F.coalesce("date", F.lit("")))


def thread_messages(messages: DataFrame) -> DataFrame:
    """Child table: the messages of each thread, with their day."""
    kept = _dated(messages).select(
        *KEY, "message_id", message_day(F.col("date")).alias("day"), "date", "arrival_seq",
        "has_attachments", "web_link",
    )
    return first_copies(kept)


def participants(messages: DataFrame) -> DataFrame:
    """Child table: distinct non-blank senders and recipients of each thread."""
    sent = F.concat(F.array("from_addr"), F.coalesce("to_addrs", F.array().cast("array<string>")))
    kept = first_copies(messages.select(*KEY, "message_id", "arrival_seq", sent.alias("sent")))
    return (
        kept.select(*KEY, F.explode("sent").alias("address"))
        .filter(F.coalesce("address", F.lit("")) != "")
        .distinct()
    )


def build_threads(messages: DataFrame) -> DataFrame:
    """Thread headers. First and last follow ``(date, arrival)``; undated is first."""
    kept = first_copies(
        _dated(messages).select(
            *KEY, "message_id", "arrival_seq", "date", "subject", "web_link", "has_attachments"
        )
    )
    order = F.struct(*ORDER)
    day = message_day(F.col("date"))
    return (
        kept.groupBy(*KEY)
        .agg(
            F.min_by(F.struct("subject", "web_link"), order).alias("first"),
            F.min("date").alias("date_first"),
            F.max("date").alias("date_last"),
            F.count("*").alias("n_messages"),
            F.min(day).alias("day_min"),
            F.max(day).alias("day_max"),
            F.bool_or(F.coalesce("has_attachments", F.lit(False))).alias("has_attachments"),
        )
        .select(
            *KEY, F.coalesce("first.subject", F.lit("")).alias("subject"), "date_first",
            "date_last", "n_messages", "day_min", "day_max", "has_attachments",
            F.coalesce("first.web_link", F.lit("")).alias("web_link"),
        )
    )


def first_last(messages: DataFrame) -> DataFrame:
    """Ids of the first and the last message of each thread."""
    kept = first_copies(_dated(messages).select(*KEY, "message_id", "arrival_seq", "date"))
    order = F.struct(*ORDER)
    return kept.groupBy(*KEY).agg(
        F.min_by("message_id", order).alias("first_id"),
        F.max_by("message_id", order).alias("last_id"),
    )


def thread_content(messages: DataFrame, limit: int = TEXT_CAP) -> DataFrame:
    """Body text, total characters and scan status of each thread.

    Bodies are cut per message, joined by blanks in order, and cut again. A
    salt slice of a thread can only contribute pieces that start before the
    cap within the slice, so a bounded list per slice reaches the last group,
    together with the slice's sums.
    """
    cut = _dated(messages).withColumn("b", message_text(F.col("body"), limit)).select(
        *KEY, *ORDER, F.col("b.text").alias("piece"), F.col("b.chars").alias("chars"),
        F.col("b.truncated").alias("truncated"),
    )
    bodies = first_copies(cut).withColumn("salt", F.pmod(F.xxhash64("message_id"), F.lit(SALTS)))
    filled = F.col("piece") != ""
    width: Column = F.when(filled, F.length("piece") + 1).otherwise(0)
    before = F.coalesce(
        F.sum(width).over(
            Window.partitionBy(*KEY, "salt").orderBy(*ORDER)
            .rowsBetween(Window.unboundedPreceding, -1)
        ), F.lit(0),
    )
    near = F.when(filled & (F.col("before") < limit), F.struct(*ORDER, "piece"))
    slices = bodies.withColumn("before", before).groupBy(*KEY, "salt").agg(
        F.sum("chars").alias("chars"), F.bool_or("truncated").alias("truncated"),
        F.sum(width).alias("width"), F.collect_list(near).alias("pieces"),
    )
    ordered = F.array_sort(F.flatten(F.collect_list("pieces")))
    return slices.groupBy(*KEY).agg(
        F.substring(F.array_join(F.transform(ordered, lambda p: p["piece"]), " "), 1, limit)
        .alias("body_text"),
        F.sum("chars").alias("body_char_count"),
        F.when(F.bool_or("truncated") | (F.sum("width") - 1 > limit), "truncated")
        .otherwise("ok").alias("body_scan_status"),
    )


def changed_threads(current: DataFrame, rebuilt: DataFrame, forced: DataFrame) -> DataFrame:
    """Rebuilt threads that are new, strictly newer, or forced."""
    known = current.select(*KEY, F.col("date_last").alias("old_last"), F.lit(True).alias("known"))
    force = forced.select(*KEY).distinct().withColumn("force", F.lit(True))
    return (
        rebuilt.join(known, KEY, "left")
        .join(force, KEY, "left")
        .filter(
            F.col("known").isNull() | F.col("force") | (F.col("date_last") > F.col("old_last"))
        )
        .drop("old_last", "known", "force")
    )


def threads_of_messages(child_messages: DataFrame, removed: DataFrame) -> DataFrame:
    """Threads that hold any of the removed message ids."""
    gone = removed.select("user_id", "message_id").distinct()
    return child_messages.join(gone, ["user_id", "message_id"], "left_semi").select(*KEY).distinct()


def touched(changes: DataFrame, child_messages: DataFrame) -> DataFrame:
    """Changed threads of all sources, and threads traced from removals (forced)."""
    named = changes.filter(F.col("thread_id").isNotNull()).select(*KEY, F.lit(False).alias("forced"))
    removed = changes.filter(F.col("removed_message_id").isNotNull()).select(
        "user_id", F.col("removed_message_id").alias("message_id")
    )
    traced = threads_of_messages(child_messages, removed).withColumn("forced", F.lit(True))
    return named.unionByName(traced).groupBy(*KEY).agg(F.bool_or("forced").alias("forced"))


def composition(threads: DataFrame) -> DataFrame:
    """Total threads, threads with attachments, threads with replies."""
    return threads.agg(
        F.count("*").alias("threads"),
        F.count_if("has_attachments").alias("with_attachments"),
        F.count_if(F.col("n_messages") > 1).alias("with_replies"),
    )
