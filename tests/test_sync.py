"""The sync query: cursor safety, replays, deletions, tags that survive."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from test_threads import frame, message
from threadlens.operators import index, tagging
from threadlens.schemas import CHANGES, STATE_EVENTS, USAGE_EVENTS
from threadlens.session import among, scratch
from threadlens.streaming import sync, usage


class Box:
    """A mailbox whose messages the test replaces between runs."""

    def __init__(self, spark):
        self.spark, self.fail, self.messages = spark, False, []
        self.feed, self.root, self.cursor = (scratch(spark, n) for n in ("feed", "root", "cursor"))
        self.mailbox = sync.Mailbox(self.read, excluded=("junk",))
        spark.createDataFrame([], CHANGES).write.parquet(self.feed)

    def read(self, spark):
        if self.fail:
            raise RuntimeError("mailbox unreachable")
        return frame(spark, *self.messages)

    def report(self, *changes):
        data = [("u", "inbox", t, r, i) for i, (t, r) in enumerate(changes)]
        self.spark.createDataFrame(data, CHANGES).coalesce(1).write.mode("append").parquet(self.feed)

    def run(self, at="now", checkpoint=None, index=False):
        sync.start_sync(
            self.spark, self.feed, self.root, checkpoint or self.cursor, self.mailbox, at, index=index
        ).awaitTermination()

    def stored(self, *columns):
        return rows(sync.current(self.spark, self.root), *columns)


@pytest.fixture
def box(spark):
    return Box(spark)


def test_store_then_resume(box):
    box.messages = [message("a", "t1", seq=1), message("b", "t2", seq=2), message("j", "t3", container_id="junk")]
    box.report(("t1", None), ("t3", None), ("t1", None))
    box.run("first")
    assert box.stored("thread_id", "n_messages", "last_synced") == [("t1", 1, "first")]
    box.report(("t2", None), ("t1", None))
    box.run("second")
    # t1 is unchanged: it is dropped and not written again
    assert box.stored("thread_id", "last_synced") == [("t1", "first"), ("t2", "second")]
    box.run("third")
    assert box.stored("thread_id", "last_synced") == [("t1", "first"), ("t2", "second")]


def test_failure_holds_the_cursor(box):
    box.messages = [message("a", "t1")]
    box.report(("t1", None))
    box.fail = True
    with pytest.raises(Exception, match="unreachable"):
        box.run()
    assert box.stored("thread_id") == []
    box.fail = False
    box.run("again")
    assert box.stored("thread_id", "last_synced") == [("t1", "again")]


def test_tags_survive_and_new_mail_updates(box, spark):
    box.messages = [message("a", "t1", date="2020-01-01", subject="old")]
    box.report(("t1", None))
    box.run("one")
    keys = "user_id string, thread_id string, tags array<string>, truncated boolean"
    sync.append_tags(spark, box.root, spark.createDataFrame([("u", "t1", ["paid"], False)], keys))
    box.messages += [message("b", "t1", date="2020-02-02", from_addr="new@x", seq=2)]
    box.report(("t1", None))
    box.run("two")
    assert box.stored("subject", "date_last", "n_messages", "ai_tags") == [("old", "2020-02-02", 2, ["paid"])]
    child = sync.current_child(spark, box.root, "thread_messages")
    assert rows(child, "message_id") == [("a",), ("b",)]
    assert ("new@x",) in rows(sync.current_child(spark, box.root, "participants"), "address")
    # A second and a third round on the same checkpoint, one with a repeated call.
    again = spark.createDataFrame([("u", "t1", ["paid", "twice"], False)], keys)
    for _ in range(2):
        assert sync.append_tags(spark, box.root, again, 1) == 1
    box.messages += [message("c", "t1", date="2020-03-03", seq=3), message("d", "t2", seq=4)]
    box.report(("t1", None), ("t2", None))
    box.run("three")
    assert box.stored("thread_id", "n_messages", "ai_tags") == [("t1", 3, ["paid", "twice"]), ("t2", 1, [])]


def test_tags_end_with_their_thread(box, spark):
    box.messages = [message("a", "t1")]
    box.report(("t1", None))
    box.run("one")
    keys = "user_id string, thread_id string, tags array<string>, truncated boolean"
    sync.append_tags(spark, box.root, spark.createDataFrame([("u", "t1", ["paid"], False)], keys))
    box.messages = []
    box.report((None, "a"))
    box.run("two")
    assert box.stored("thread_id") == []
    box.messages = [message("b", "t1")]
    box.report(("t1", None))
    box.run("three")
    assert box.stored("thread_id", "ai_tags") == [("t1", [])]


def test_index_follows_syncs_and_tags(box, spark):
    def found(token):
        return rows(sync.postings(spark, box.root, "terms").filter(F.col("token") == token), "thread_id")

    box.mailbox.excluded = ()
    box.messages = [message("a", "t1", subject="alpha"), message("b", "t2", subject="beta", seq=2)]
    box.report(("t1", None), ("t2", None))
    box.run("one", index=True)
    assert found("alpha") == [("t1",)] and found("beta") == [("t2",)]
    keys = "user_id string, thread_id string, tags array<string>, truncated boolean"
    sync.append_tags(spark, box.root, spark.createDataFrame([("u", "t1", ["paid"], False)], keys), index=True)
    assert found("paid") == [("t1",)] and found("alpha") == [("t1",)]
    box.messages = box.messages[:1] + [message("c", "t1", date="2030-01-01", from_addr="gamma@x", seq=3)]
    box.report(("t1", None), (None, "b"))
    box.run("two", index=True)
    assert found("beta") == [] and found("gamma") == [("t1",)] and found("paid") == [("t1",)]
    assert sync.postings(spark, box.root, "positions").filter("token = 'paid'").count() == 1
    # The statistics kept by signed deltas are those of the postings, after new, changed and tagged threads.
    kept = rows(sync.term_statistics(spark, box.root))
    assert kept == rows(index.statistics(sync.postings(spark, box.root, "terms"))) and kept


def test_a_batch_reads_only_its_buckets(box, spark):
    stored = scratch(spark, "box")
    sync.store_mailbox(frame(spark, *[message(str(k), f"t{k}", seq=k) for k in range(60)]), stored)
    box.mailbox = sync.Mailbox(lambda s: s.read.parquet(stored))
    box.report(*[(f"t{k}", None) for k in range(60)])
    box.run("one")
    assert len(box.stored("thread_id")) == 60
    log = sync._log(spark, box.root, "threads", None, [3])
    scan = log._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters")[1].split("]")[0]
    assert {r[0].split("bucket=")[1][0] for r in log.select(F.input_file_name()).collect()} <= {"3"}


def test_a_mailbox_is_stored_without_a_shuffle(spark):
    stored = scratch(spark, "box")
    mail = frame(spark, *[message(str(k), f"t{k}", seq=k) for k in range(60)]).coalesce(1)
    sync.store_mailbox(mail, stored)
    read = spark.read.parquet(stored)
    assert read.count() == 60 and read.filter(F.col("bucket") != sync.bucket()).isEmpty()
    # One task wrote them, a file a bucket.
    names = [r[0].split("/")[-1].split("-")[1] for r in read.select(F.input_file_name()).distinct().collect()]
    assert set(names) == {"00000"}


def test_rows_of_many_keys_are_thinned_before_the_join(spark):
    rows_ = spark.range(40000).selectExpr("if(id % 5 = 0, null, concat('u', id % 7)) user_id", "concat('t', id) thread_id", "id")
    keys = rows_.filter("id % 40 = 3 OR id % 800 = 0").select("user_id", "thread_id")
    few = among(rows_, keys, ["user_id", "thread_id"])
    many = among(rows_, keys, ["user_id", "thread_id"], few=10)
    assert many.columns == few.columns and rows(many) == rows(few) and many.count() == 1000
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    # The filter by the broadcast bitmap lies below the exact join.
    assert plan.index("thread_id") >= 0 and plan.count("Join") == 2 and "getbit" in plan.split("Join")[2]


def test_removed_message_forces_and_deletes(box, spark):
    box.messages = [message("a", "t1", date="2020-01-01", seq=1), message("b", "t1", date="2020-02-02", seq=2),
                    message("c", "t2", seq=3)]
    box.report(("t1", None), ("t2", None))
    box.run("one")
    box.messages = box.messages[:1]
    box.report((None, "b"), (None, "c"), (None, "unknown"))
    box.run("two")
    assert box.stored("thread_id", "date_last", "n_messages") == [("t1", "2020-01-01", 1)]
    assert rows(sync.current_child(spark, box.root, "thread_messages"), "message_id") == [("a",)]


def test_replayed_batch_leaves_the_same_rows(box, spark):
    box.messages = [message("a", "t1"), message("b", "t2")]
    changes = spark.createDataFrame([("u", "s", "t1", None, 1), ("u", "s", "t2", None, 2)], CHANGES)
    for _ in range(2):
        sync.apply_batch(changes, 0, box.root, box.mailbox, "x")
        assert box.stored("thread_id") == [("t1",), ("t2",)]
    target = scratch(spark, "compact")
    sync.compact(spark, box.root, target)
    assert rows(sync.current(spark, target), "thread_id") == [("t1",), ("t2",)]
    assert sync.current_child(spark, target, "thread_messages").count() == 2


def test_attachments_reach_the_thread_row(box, spark):
    box.messages = [message("a", "t1", has_attachments=True)]
    box.mailbox.meta = lambda s: s.createDataFrame(
        [("u", "a", "1", "x.pdf", "", 7), ("other", "a", "2", "y.pdf", "", 99)],
        "user_id string, message_id string, attachment_id string, name string, content_type string, size bigint")
    box.mailbox.texts = lambda s: s.createDataFrame(
        [], "user_id string, message_id string, attachment_id string, text string")
    box.report(("t1", None))
    box.run()
    assert box.stored("max_attachment_size", "attachments_incomplete") == [(7, True)]
    assert rows(sync.current_child(spark, box.root, "attachments"), "name", "scan_status") == [("x.pdf", "failed")]


def test_stop_between_batches(box, spark):
    box.messages = [message("a", "t1")]
    query = sync.start_sync(spark, box.feed, box.root, box.cursor, box.mailbox, available_now=False)
    sync.stop_sync(query)
    assert not query.isActive
    box.report(("t1", None))
    box.run("later")
    assert box.stored("thread_id") == [("t1",)]


def test_sync_then_tag(box, spark):
    box.messages = [message("a", "t1", body="invoice invoice payment")]
    box.report(("t1", None))
    box.run()
    from threadlens.operators.threads import thread_content

    threads = sync.current(spark, box.root)
    people = sync.current_child(spark, box.root, "participants")
    tags = tagging.retag(threads, box.read(spark), people, thread_content)
    sync.append_tags(spark, box.root, tags)
    assert box.stored("ai_tags")[0][0][0] == "invoice"
    assert tagging.untagged(sync.current(spark, box.root)).count() == 0


def test_usage_stream_counts_by_event_day(spark):
    folder = scratch(spark, "usage")
    e = spark.sql("""SELECT * FROM VALUES ('u', timestamp'2024-01-31 23:59:59', '', true, 1L, 2L, 3L),
        ('u', timestamp'2024-02-01 00:00:01', '', true, 10L, 20L, 30L),
        ('u', timestamp'2024-02-01 09:00:00', '', false, 100L, 200L, 300L),
        ('u', timestamp'2024-02-01 10:00:00', '', false, 1L, 1L, 1L)
        t(user_id, ts, day, batched, input_tokens, output_tokens, cache_read_tokens)""")
    e.write.parquet(folder)
    stream = spark.readStream.schema(USAGE_EVENTS).parquet(folder)
    root, cursor = scratch(spark, "counters"), scratch(spark, "cp")
    usage.start_usage(stream, root, cursor).awaitTermination()
    assert rows(usage.usage_counters(spark, root), "day", "batched", "requests", "input_tokens") == [
        ("2024-01-31", True, 1, 1), ("2024-02-01", False, 2, 101), ("2024-02-01", True, 1, 10)]
    # Usage that is reported months late still counts.
    late = spark.sql("SELECT 'u' user_id, timestamp'2023-06-01 00:00:00' ts, '' day, true batched, 5L input_tokens, null output_tokens, 1L cache_read_tokens")
    late.selectExpr("user_id", "ts", "day", "batched", "input_tokens", "CAST(output_tokens AS BIGINT) output_tokens", "cache_read_tokens").write.mode("append").parquet(folder)
    usage.start_usage(stream, root, cursor).awaitTermination()
    assert ("2023-06-01", True, 1, 5, 0) in rows(
        usage.usage_counters(spark, root), "day", "batched", "requests", "input_tokens", "output_tokens")


def test_heartbeat_goes_stale_in_silence(spark):
    folder = scratch(spark, "beats")
    spark.createDataFrame([("u", "progress_status", "tagging", 1), ("v", "progress_status", "done", 2)],
                          STATE_EVENTS).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(STATE_EVENTS).parquet(folder)
    query = (
        usage.heartbeat_stream(stream, stale_after=1).writeStream.outputMode("update").format("memory")
        .queryName("beats").option("checkpointLocation", scratch(spark, "cp"))
        .trigger(processingTime="1 second").start()
    )
    import time

    end = time.time() + 60
    try:
        while time.time() < end and spark.table("beats").filter("stale").isEmpty():
            time.sleep(1)
        assert rows(spark.table("beats")) == [
            ("u", "tagging", False), ("u", "tagging", True), ("v", "done", False)]
    finally:
        query.stop()
