"""Raw pages of change feeds as a sync, with a position for each source.

Pages ``(user_id, source_id, payload, seq)`` of all sources arrive in one stream.
A page that cannot be read, or whose source reports a failure, holds its own
source at that page: the page and those after it are not applied, while all other
sources advance. Held pages are put aside under ``<root>/quarantine`` with an error.

``<root>/cursors`` keeps the position of each source, the last page applied, and
the page it is held at, if any. It is written after the rows of the batch, so a
position never covers rows that are not stored; a replayed batch starts from the
positions before it and writes the same ones again.

:func:`ask_again` names the sources whose pages are to be delivered again, from
``held_at`` on. A readable copy of that page releases its source. Pages that were
applied before may come again: a change only names a thread, which is rebuilt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlens.session import materialise
from threadlens.sources import changes as feed
from threadlens.sources.providers import unreadable
from threadlens.streaming import runs, sync

PAGES = "user_id string, source_id string, payload string, seq bigint"
SOURCE = sync.PLACED["cursors"]
#: The shape of a page, and what turns pages into change rows.
FORMATS = {
    "delta": (feed.DELTA_PAGE, feed.delta_to_changes),
    "history": (feed.HISTORY_PAGE, feed.history_to_changes),
}


def positions(spark: SparkSession, root: str, before: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(user_id, source_id, position, held_at): the newest row of each source.

    ``sources`` thins the log before rows are grouped; only its buckets are read.
    """
    buckets = None if sources is None else sync._numbers(sources, *SOURCE)
    rows = sync._log(spark, root, "cursors", before, buckets)
    if sources is not None:
        rows = rows.join(sources.select(*SOURCE), SOURCE, "left_semi")
    newest = rows.groupBy(*SOURCE).agg(F.max_by(F.struct("position", "held_at"), "at").alias("c"))
    return newest.select(*SOURCE, "c.position", "c.held_at")


def ask_again(spark: SparkSession, root: str) -> DataFrame:
    """(user_id, source_id, held_at): sources whose pages are to be delivered again, from ``held_at`` on."""
    return positions(spark, root).filter("held_at IS NOT NULL").drop("position")


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """(user_id, source_id, payload, seq, error, at): pages put aside, with the batch that did it."""
    return sync._log(spark, root, "quarantine")


def judged(pages: DataFrame, schema: str, failing: DataFrame | None = None) -> DataFrame:
    """Pages with an ``error``, null for those that can be applied.

    Pages without a number have no place in their source: they are errors too, but hold nothing.
    """
    wrong = F.when(F.col("payload").isNull(), "no payload").when(
        unreadable(F.col("payload"), schema), "malformed payload").when(F.col("seq").isNull(), "no number")
    pages = pages.select("user_id", "source_id", "payload", "seq")
    if failing is None:
        return pages.withColumn("error", wrong)
    failed = failing.select(*SOURCE).distinct().withColumn("failed", F.lit(True))
    return pages.join(failed, SOURCE, "left").withColumn(
        "error", F.when(F.col("failed"), "source failed").otherwise(wrong)).drop("failed")


def stops(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(user_id, source_id, position, held_at) after the pages of a batch.

    ``pages`` are :func:`judged`, ``known`` the positions before. A source is held
    at the first page of which no readable copy is there, be it of this batch or
    the one it was held at before.
    """
    numbered = pages.filter("seq IS NOT NULL").groupBy(*SOURCE, "seq").agg(
        F.bool_or(F.col("error").isNull()).alias("good"))
    held = known.filter("held_at IS NOT NULL").select(
        *SOURCE, F.col("held_at").alias("seq"), F.lit(False).alias("good"))
    here = numbered.unionByName(held).groupBy(*SOURCE, "seq").agg(F.bool_or("good").alias("good"))
    first_bad = here.groupBy(*SOURCE).agg(F.min(F.when(~F.col("good"), F.col("seq"))).alias("held_at"))
    last = _applied(numbered.filter("good"), first_bad).groupBy(*SOURCE).agg(F.max("seq").alias("last"))
    return (
        first_bad.join(last, SOURCE, "left").join(known.select(*SOURCE, "position"), SOURCE, "left")
        .select(*SOURCE, F.greatest("position", "last").alias("position"), "held_at")
    )


def _applied(pages: DataFrame, after: DataFrame) -> DataFrame:
    """Pages that lie before the page their source is held at."""
    held = after.filter("held_at IS NOT NULL").select(*SOURCE, "held_at")
    return pages.join(held, SOURCE, "left").filter("held_at IS NULL OR seq < held_at").drop("held_at")


def apply_pages(
    pages: DataFrame, batch: int, root: str, mailbox: sync.Mailbox, synced_at: str, form: str = "delta",
    failing: DataFrame | None = None, index: bool = False,
) -> None:
    """One micro-batch: sources held where a page fails, the others applied, then positions stored."""
    spark = pages.sparkSession
    schema, parsed = FORMATS[form]
    pages = materialise(judged(pages, schema, failing), "pages")
    sources = materialise(pages.select(*SOURCE).distinct(), "sources")
    known = positions(spark, root, batch, sources)
    after = materialise(stops(pages, known), "positions")
    ready = materialise(parsed(_applied(pages.filter("error IS NULL"), after)), "changes")
    sync.apply_batch(ready, batch, root, mailbox, synced_at, index)
    # Last: positions cover stored rows only.
    runs.commit(spark, root, [
        sync._store(pages.filter("error IS NOT NULL"), root, "quarantine", batch),
        sync._store(after, root, "cursors", batch)])


def start_feed_sync(
    spark: SparkSession, pages_path: str, root: str, checkpoint: str, mailbox: sync.Mailbox, synced_at: str = "",
    form: str = "delta", failing: Callable[[SparkSession], DataFrame] | None = None, available_now: bool = True,
    files_per_batch: int | None = None, index: bool = False,
) -> StreamingQuery:
    """Start a sync over a folder of page files.

    ``failing`` lists the sources (user_id, source_id) that could not be reached
    this time, asked for once per batch.
    """
    reader = spark.readStream.schema(PAGES)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    offset = sync._next_batch(spark, root, checkpoint)

    def store(batch_df: DataFrame, batch_id: int) -> None:
        down = failing(spark) if failing else None
        apply_pages(batch_df, offset + batch_id, root, mailbox, synced_at, form, down, index)

    writer = reader.parquet(pages_path).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")).start()
