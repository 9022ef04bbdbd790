"""Incremental sync as a Structured Streaming query.

Change rows arrive as a stream; its checkpoint is the cursor of every source.
A micro-batch rebuilds the touched threads from the mailbox and appends their
new rows to logs, one run of files a table (:mod:`threadlens.streaming.runs`). All
tables of a batch become visible by one change of the manifest. A replayed batch
replaces its own runs, so it leaves the same rows. If anything fails the batch
raises and the checkpoint does not move.

Buckets are hash ranges of ``(user_id, thread_id)``. A batch collects the numbers
of its buckets (at most ``BUCKETS``) and reads only their folders of the live runs.
Each batch first folds runs of earlier ones where a tier is full, so the number of
folders a batch meets does not grow with the number of batches before it.

Tags are a log of their own, numbered by ``seq``, that no sync writes, so syncs and
taggers never take each other's numbers. A tag row names the last batch that its
tagger saw; it counts for the thread as long as the thread was not deleted and
created anew after that batch.

With ``index`` a sync also keeps the token index (``terms``, ``positions``) of the
threads that it or :func:`append_tags` changed, by the same kind of log.

The current table is the newest row per thread (:func:`current`), so a batch
costs what it changes; :func:`compact` folds the log into a new base.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from threadlens.operators import attachments as att
from threadlens.operators import index as ix
from threadlens.operators import mutate, threads as th
from threadlens.operators.tagging import last_rows
from threadlens.schemas import ATTACHMENTS, CHANGES, KEY, PARTICIPANTS, THREAD_MESSAGES, THREADS
from threadlens.session import FEW_KEYS, among, materialise
from threadlens.sources.changes import read_changes
from threadlens.streaming import runs

CHILDREN = {
    "thread_messages": THREAD_MESSAGES, "participants": PARTICIPANTS, "attachments": ATTACHMENTS,
}
POSTINGS = {
    "terms": "user_id string, thread_id string, token string",
    "positions": "user_id string, thread_id string, pos bigint, token string",
}
HOLDERS = "user_id string, message_id string, thread_id string"
TERM_COUNTS = "user_id string, token string, d bigint"
TAGS = "user_id string, thread_id string, tags array<string>, truncated boolean, as_of bigint"
CURSORS = "user_id string, source_id string, position bigint, held_at bigint"
QUARANTINE = "user_id string, source_id string, payload string, seq bigint, error string"
BUCKETS = 16
#: Room for the tag changes between two batches in the order of index entries.
TURNS = 1 << 31


def bucket(*columns: str) -> Column:
    """The bucket of a thread, or of other keys."""
    return F.pmod(F.xxhash64(*(columns or KEY)), F.lit(BUCKETS)).cast("int")


@dataclass
class Mailbox:
    """Where a sync reads: messages, and optionally attachments with texts.

    Messages stored by :func:`store_mailbox` are read by bucket.
    """

    messages: Callable[[SparkSession], DataFrame]
    excluded: tuple[str, ...] = ()
    meta: Callable[[SparkSession], DataFrame] | None = None
    texts: Callable[[SparkSession], DataFrame] | None = None


def store_mailbox(messages: DataFrame, path: str) -> None:
    """Messages in bucket folders, so that a sync scans those of its threads.

    They are not shuffled for it: each task sorts its rows by bucket and writes a file a
    bucket, so messages should come in partitions that fit into memory.
    """
    messages.withColumn("bucket", bucket()).write.partitionBy("bucket").mode("append").parquet(path)


def _together(spark: SparkSession, *jobs: Callable):
    """Run jobs that do not need each other at the same time; their results in order."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _numbers(keys: DataFrame, *columns: str) -> list[int]:
    """The buckets of some keys, at most ``BUCKETS`` numbers."""
    return [r[0] for r in keys.select(bucket(*columns)).distinct().collect()]


def _schema(table: str) -> T.StructType:
    ddl, number, _ = LOGS[table]
    kept = "" if number != "batch" else ", deleted boolean, content_batch bigint, created_batch bigint"
    return T.StructType.fromDDL(f"{ddl}{kept}, {number} bigint, bucket int")


def _log(
    spark: SparkSession, root: str, table: str, before: int | None = None, buckets: list[int] | None = None,
) -> DataFrame:
    """The rows of a log, of numbers below ``before`` and of some buckets only where given."""
    live = [r for r in runs.live(spark, root, table) if before is None or r.lo < before]
    rows = runs.read(spark, root, table, _schema(table), live, buckets).drop("bucket")
    return rows if before is None else rows.filter(F.col(LOGS[table][1]) < before)


def _rows(
    spark: SparkSession, root: str, before: int | None = None, keys: DataFrame | None = None,
    buckets: list[int] | None = None,
) -> DataFrame:
    """Newest thread rows. ``keys`` and ``buckets`` thin the log before rows are grouped."""
    rows = _log(spark, root, "threads", before, buckets)
    if keys is not None:
        rows = rows.join(keys.select(*KEY), KEY, "left_semi")
    rest = [c for c in rows.columns if c not in (*KEY, "batch")]
    latest = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "batch").alias("t"))
    return latest.filter(~F.col("t.deleted")).select(*KEY, "t.*").drop("deleted")


def _tagged(spark: SparkSession, root: str, rows: DataFrame, buckets: list[int] | None = None) -> DataFrame:
    """Thread rows with their newest tags."""
    log = _log(spark, root, "tags", None, buckets)
    newest = last_rows(log, KEY, "seq")
    hit = F.coalesce(F.col("as_of") >= F.col("created_batch"), F.lit(False))
    return rows.join(newest, KEY, "left").withColumns({
        "ai_tags": F.when(hit, F.col("tags")).otherwise(F.col("ai_tags")),
        "tags_truncated": F.when(hit, F.col("truncated")).otherwise(F.col("tags_truncated")),
    }).drop("tags", "truncated", "as_of")


def _of_few(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    """The rows of some threads where these are few; others are left to the join that follows."""
    if keys is None or keys.count() > FEW_KEYS:
        return rows
    return rows.join(keys.select(*KEY), KEY, "left_semi")


def _numbered(rows: DataFrame, newest: DataFrame, number: str) -> DataFrame:
    """The rows whose ``number`` is that of their thread in ``newest``, which holds each thread once."""
    newest = newest.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col(number).alias("_number"))
    same = [F.col(c) == F.col(f"_{c}") for c in KEY]
    # A difference is no join key, so both sides are dealt by thread, as grouped numbers already are.
    return rows.join(newest, [*same, F.col(number) - F.col("_number") == 0], "left_semi").drop(number)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The threads table: newest row per key with its tags, deleted keys left out."""
    return _tagged(spark, root, _rows(spark, root)).drop("content_batch", "created_batch")


def current_child(
    spark: SparkSession, root: str, table: str, before: int | None = None, keys: DataFrame | None = None,
    buckets: list[int] | None = None,
) -> DataFrame:
    """A child table: the rows of the batch that last rebuilt each thread."""
    return _child(spark, root, table, _rows(spark, root, before, keys, buckets), before, buckets, keys)


def _child(
    spark: SparkSession, root: str, table: str, threads: DataFrame, before: int | None = None,
    buckets: list[int] | None = None, keys: DataFrame | None = None,
) -> DataFrame:
    """The rows of a child table that belong to some thread rows."""
    rows = _log(spark, root, table, before, buckets).drop("deleted", "content_batch", "created_batch")
    rows = _of_few(rows, keys)
    return _numbered(rows, threads.select(*KEY, F.col("content_batch").alias("batch")), "batch")


#: Tables whose bucket is not that of the thread.
PLACED = {
    "holders": ["user_id", "message_id"], "term_counts": ["user_id", "token"],
    "cursors": ["user_id", "source_id"], "quarantine": ["user_id", "source_id"],
}


def _newest(number: str, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Folds rows to those of the highest number of each key."""
    def merge(rows: DataFrame) -> DataFrame:
        newest = rows.groupBy(*keys).agg(F.max(number).alias(number))
        return rows.join(newest, [*keys, number], "left_semi")
    return merge


def _folded_holders(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "message_id", "thread_id", "bucket").agg(F.max("at").alias("at"))


def _folded_counts(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("user_id", "token", "bucket").agg(F.sum("d").alias("d"), F.max("turn").alias("turn"))
    return sums.filter("d <> 0")


#: The logs: columns, the column that numbers them, and how runs of earlier numbers are folded.
LOGS = {
    "threads": (THREADS, "batch", _newest("batch", KEY)),
    **{name: (ddl, "batch", _newest("batch", KEY)) for name, ddl in CHILDREN.items()},
    "holders": (HOLDERS, "at", _folded_holders),
    "tags": (TAGS, "seq", _newest("seq", KEY)),
    **{name: (ddl, "turn", _newest("turn", KEY)) for name, ddl in POSTINGS.items()},
    "indexed": ("user_id string, thread_id string", "turn", _newest("turn", KEY)),
    "term_counts": (TERM_COUNTS, "turn", _folded_counts),
    "cursors": (CURSORS, "at", _newest("at", PLACED["cursors"])),
    "quarantine": (QUARANTINE, "at", lambda rows: rows),
}


def _store(df: DataFrame, root: str, table: str, number: int) -> runs.Run:
    """Rows as the run of a number, which is not visible before it is committed."""
    named = LOGS[table][1]
    given = {
        "deleted": F.lit(False), "content_batch": F.lit(number), "created_batch": F.lit(number),
    }
    place = bucket(*PLACED.get(table, KEY))
    rows = df.select(*[
        place.alias("bucket") if f.name == "bucket" else
        (F.lit(number) if f.name == named else F.col(f.name) if f.name in df.columns
         else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in _schema(table).fields
    ])
    return runs.write(rows, root, table, str(number), number, number)


def _append(df: DataFrame, root: str, table: str, number: int) -> None:
    runs.commit(df.sparkSession, root, [_store(df, root, table, number)])


def _stored(spark: SparkSession, root: str, run: runs.Run) -> DataFrame:
    """The rows of one run, visible or not."""
    return runs.read(spark, root, run.table, _schema(run.table), [run]).drop("bucket")


def fold(spark: SparkSession, root: str, batch: int) -> int:
    """Fold full tiers of every log, of numbers that a sync at ``batch`` can no longer write again.

    The newest tags stay apart as well: their call may be repeated.
    """
    below = {"batch": batch, "at": batch, "turn": batch * TURNS, "seq": runs.last(spark, root, "tags") or 0}
    due = {r.table for r in runs.live(spark, root)}
    return sum(
        runs.fold(spark, root, table, _schema(table), below[number], merge)
        for table, (_, number, merge) in LOGS.items() if table in due)


def _holders(spark: SparkSession, root: str, removed: DataFrame, batch: int) -> DataFrame:
    """The current child rows of removed messages, found through their bucketed message ids."""
    buckets = _numbers(removed, "user_id", "message_id") if runs.live(spark, root, "holders") else []
    if not buckets:
        return spark.createDataFrame([], "user_id string, message_id string, thread_id string")
    found = _log(spark, root, "holders", batch, buckets).join(
        removed, ["user_id", "message_id"], "left_semi").select(*KEY).distinct()
    keys = materialise(found, "holders")
    rows = current_child(spark, root, "thread_messages", batch, keys, _numbers(keys))
    return rows.join(removed, ["user_id", "message_id"], "left_semi")


def apply_batch(
    changes: DataFrame, batch: int, root: str, mailbox: Mailbox, synced_at: str, index: bool = False
) -> None:
    """One micro-batch: touched threads rebuilt, compared, stored.

    What several steps read (touched keys, their mail, the changed threads) is
    written to the shared folder once.
    """
    spark = changes.sparkSession
    fold(spark, root, batch)
    removed = changes.filter("removed_message_id is not null").select(
        "user_id", F.col("removed_message_id").alias("message_id")
    ).distinct()
    touched = materialise(th.touched(changes, _holders(spark, root, removed, batch)), "touched")
    buckets = _numbers(touched)
    source = mailbox.messages(spark)
    if "bucket" in source.columns:
        source = source.filter(F.col("bucket").isin(buckets)).drop("bucket")
    held = among(th.drop_containers(source, list(mailbox.excluded)), touched, KEY)
    mail, known = _together(
        spark, lambda: materialise(held, "mail"),
        lambda: materialise(_rows(spark, root, batch, touched, buckets), "known"))
    rebuilt = th.build_threads(mail)
    changed = materialise(th.changed_threads(known, rebuilt, touched.filter("forced")), "changed")
    keys = changed.select(*KEY)
    gone = known.select(*KEY).join(mail.select(*KEY), KEY, "left_anti")
    kept_mail = mail.join(keys, KEY, "left_semi")
    old = known.drop("content_batch").join(keys, KEY, "left_semi")

    def store_threads(files: DataFrame | None = None) -> runs.Run:
        rows = changed.join(th.thread_content(kept_mail).drop("body_text"), KEY, "left")
        if files is not None:
            rows = rows.join(att.per_thread(files), KEY, "left")
        else:
            rows = rows.withColumns({
                "max_attachment_size": F.lit(None).cast("bigint"),
                "attachments_incomplete": F.lit(None).cast("boolean"),
            })
        rows = rows.withColumns({
            "ai_tags": F.array().cast("array<string>"), "user_tags": F.array().cast("array<string>"),
            "manually_reviewed": F.lit(False), "tags_truncated": F.lit(False),
            "last_synced": F.lit(synced_at),
        })
        stored = mutate.store_untagged(old, rows).withColumns({
            "deleted": F.lit(False), "created_batch": F.coalesce("created_batch", F.lit(batch))})
        out = stored.unionByName(gone.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
        return _store(out, root, "threads", batch)

    def store_files(child: DataFrame) -> list[runs.Run]:
        """Attachments, and the thread rows that count them."""
        found = att.storage_columns(att.attach(child, mailbox.meta(spark), mailbox.texts(spark)))
        files = _store(found, root, "attachments", batch)
        return [files, store_threads(_stored(spark, root, files))]

    def store_child() -> list[runs.Run]:
        """Messages, and what is derived from them."""
        messages = _store(th.thread_messages(kept_mail), root, "thread_messages", batch)
        child = _stored(spark, root, messages)
        later = [lambda: [_store(child, root, "holders", batch)]]
        if mailbox.meta is not None:
            later.append(lambda: store_files(child))
        return [messages, *[run for done in _together(spark, *later) for run in done]]

    jobs = [store_child, lambda: [_store(th.participants(kept_mail), root, "participants", batch)]]
    if mailbox.meta is None:
        jobs.append(lambda: [store_threads()])
    done = _together(spark, *jobs)
    # All tables of the batch become visible at once.
    runs.commit(spark, root, [run for stored in done for run in stored])
    if index:
        _index(spark, root, keys.unionByName(gone), batch * TURNS)


def _last_batch(spark: SparkSession, root: str) -> int:
    last = runs.last(spark, root, "threads")
    return -1 if last is None else last


def append_tags(
    spark: SparkSession, root: str, tags: DataFrame, seq: int | None = None, index: bool = False
) -> int:
    """Store tagger results; returns their number, under which a failed call can be repeated."""
    if seq is None:
        last = runs.last(spark, root, "tags")
        seq = 0 if last is None else last + 1
    as_of = _last_batch(spark, root)
    kept = tags.select(*KEY, "tags", "truncated", *[c for c in ("seq",) if c in tags.columns])
    rows = materialise(last_rows(kept, KEY, "seq").withColumn("as_of", F.lit(as_of)), "tags")
    _append(rows, root, "tags", seq)
    if index:
        _index(spark, root, rows, as_of * TURNS + seq + 1)
    return seq


def _index(spark: SparkSession, root: str, changed: DataFrame, turn: int) -> None:
    """Postings of the changed threads as they are now; their older ones no longer count."""
    changed = materialise(changed.select(*KEY).distinct(), "reindexed")
    buckets = _numbers(changed)
    threads = materialise(_tagged(spark, root, _rows(spark, root, None, changed, buckets), buckets), "reindexed")
    # Terms and positions read them several times.
    people = materialise(_child(spark, root, "participants", threads, None, buckets), "reindexed")
    before = materialise(postings(spark, root, "terms", turn, changed, buckets), "unindexed")

    def store(name: str, build: Callable) -> list[runs.Run]:
        run = _store(build(threads, people), root, name, turn)
        if name != "terms":
            return [run]
        counts = ix.deltas(before, _stored(spark, root, run).drop("turn"))
        return [run, _store(counts, root, "term_counts", turn)]

    done = _together(
        spark, lambda: store("terms", ix.unordered_terms), lambda: store("positions", ix.positions),
        lambda: [_store(changed, root, "indexed", turn)])
    runs.commit(spark, root, [run for stored in done for run in stored])


def postings(
    spark: SparkSession, root: str, name: str, before: int | None = None, keys: DataFrame | None = None,
    buckets: list[int] | None = None,
) -> DataFrame:
    """``terms`` or ``positions`` of all threads as last indexed; ``keys`` and ``buckets`` thin the logs first."""
    turns = _log(spark, root, "indexed", before, buckets)
    if keys is not None:
        turns = turns.join(keys.select(*KEY), KEY, "left_semi")
    newest = turns.groupBy(*KEY).agg(F.max("turn").alias("turn"))
    return _numbered(_of_few(_log(spark, root, name, before, buckets), keys), newest, "turn")


def term_statistics(spark: SparkSession, root: str) -> DataFrame:
    """(user_id, token, df) as syncs and taggers have kept it by signed deltas."""
    return ix.summed(_log(spark, root, "term_counts"))


def start_sync(
    spark: SparkSession, changes_path: str, root: str, checkpoint: str, mailbox: Mailbox,
    synced_at: str = "", available_now: bool = True, files_per_batch: int | None = None,
    index: bool = False,
) -> StreamingQuery:
    """Start the sync query. A new ``checkpoint`` forgets all cursors and keeps the tables."""
    feed = read_changes_stream(spark, changes_path, files_per_batch)
    offset = _next_batch(spark, root, checkpoint)

    def store(batch_df: DataFrame, batch_id: int) -> None:
        apply_batch(batch_df, offset + batch_id, root, mailbox, synced_at, index)

    writer = feed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds"
    )
    return writer.start()


def read_changes_stream(spark: SparkSession, path: str, files_per_batch: int | None) -> DataFrame:
    if files_per_batch is None:
        return read_changes(spark, path, streaming=True)
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _next_batch(spark: SparkSession, root: str, checkpoint: str) -> int:
    """Number added to the query's batch ids, fixed per checkpoint.

    A checkpoint started over counts from zero again; its rows must come after
    the rows already stored, so its first batch continues their numbering.
    """
    path = f"{root}/_offsets"
    known = spark.createDataFrame([], "checkpoint string, start bigint")
    if _exists(spark, path):
        known = spark.read.schema("checkpoint string, start bigint").parquet(path)
    row = known.filter(F.col("checkpoint") == checkpoint).agg(F.min("start")).first()
    if row[0] is not None:
        return row[0]
    # A batch in which every source was held stored positions alone.
    last = runs.last(spark, root, "cursors")
    start = max(_last_batch(spark, root), -1 if last is None else last) + 1
    spark.createDataFrame([(checkpoint, start)], "checkpoint string, start bigint").coalesce(
        1
    ).write.mode("append").parquet(path)
    return start


def stop_sync(query: StreamingQuery) -> None:
    """Stop between micro-batches: a batch under way is replayed on restart."""
    query.stop()


def compact(spark: SparkSession, root: str, target: str) -> None:
    """All logs as one base batch under ``target``, without rows that no longer count; switch readers to it after."""
    last = max(0, _last_batch(spark, root))
    there = {r.table for r in runs.live(spark, root)}
    child = current_child(spark, root, "thread_messages")
    base = [(name, current_child(spark, root, name), last) for name in CHILDREN]
    base += [("holders", child.select("user_id", "message_id", "thread_id"), last)]
    if "cursors" in there:
        base += [("cursors", last_rows(_log(spark, root, "cursors"), PLACED["cursors"], "at"), last)]
    if "quarantine" in there:
        base += [("quarantine", _log(spark, root, "quarantine"), last)]
    if "tags" in there:
        base += [("tags", last_rows(_log(spark, root, "tags"), KEY, "seq"), 0)]
    if "indexed" in there:
        turn = last * TURNS
        base += [(name, postings(spark, root, name), turn) for name in POSTINGS]
        base += [("indexed", current(spark, root).select(*KEY), turn),
                 ("term_counts", _log(spark, root, "term_counts").groupBy("user_id", "token").agg(
                     F.sum("d").alias("d")).filter("d <> 0"), turn)]
    base += [("threads", _rows(spark, root).drop("content_batch"), last)]
    runs.commit(spark, target, [_store(rows, target, name, number) for name, rows, number in base])
