"""Pages of many sources: bad ones hold their own source, positions follow stored rows."""

import json

import pytest

from helpers import rows
from test_threads import frame, message
from threadlens.session import scratch
from threadlens.streaming import feeds, sync


def page(source, seq, *threads, user="u"):
    return (user, source, json.dumps({"value": [{"id": f"m{t}", "conversationId": t} for t in threads]}), seq)


class Feed:
    def __init__(self, spark):
        self.spark, self.messages, self.fail, self.down = spark, [], False, []
        self.pages, self.root, self.cursor = (scratch(spark, n) for n in ("pages", "root", "cursor"))
        self.mailbox = sync.Mailbox(self.read)
        spark.createDataFrame([], feeds.PAGES).write.parquet(self.pages)

    def read(self, spark):
        if self.fail:
            raise RuntimeError("mailbox unreachable")
        return frame(spark, *self.messages)

    def run(self, *pages, checkpoint=None):
        if pages:
            self.spark.createDataFrame(list(pages), feeds.PAGES).coalesce(1).write.mode("append").parquet(self.pages)
        failing = lambda s: s.createDataFrame([("u", d) for d in self.down], "user_id string, source_id string")
        feeds.start_feed_sync(
            self.spark, self.pages, self.root, checkpoint or self.cursor, self.mailbox, failing=failing).awaitTermination()

    def at(self):
        return {r.source_id: (r.position, r.held_at) for r in feeds.positions(self.spark, self.root).collect()}

    def threads(self):
        return [t for t, in rows(sync.current(self.spark, self.root), "thread_id")]


@pytest.fixture
def box(spark):
    f = Feed(spark)
    f.messages = [message(f"m{k}", f"t{k}", seq=k) for k in range(1, 10)]
    return f


def test_a_bad_page_holds_its_source_alone(box, spark):
    box.run(page("a", 1, "t1"), ("u", "a", '{"value": [', 2), page("a", 3, "t3"), page("b", 7, "t4"))
    assert box.at() == {"a": (1, 2), "b": (7, None)} and box.threads() == ["t1", "t4"]
    assert rows(feeds.quarantined(spark, box.root), "source_id", "seq", "error") == [("a", 2, "malformed payload")]
    # Later pages of the held source wait for it to be asked again; others go on.
    box.run(page("a", 4, "t5"), page("b", 8, "t6"))
    assert box.at() == {"a": (1, 2), "b": (8, None)} and box.threads() == ["t1", "t4", "t6"]
    assert rows(feeds.ask_again(spark, box.root)) == [("u", "a", 2)]
    box.run(page("a", 2, "t2"), page("a", 3, "t3"), page("a", 4, "t5"))
    assert box.at() == {"a": (4, None), "b": (8, None)}
    assert box.threads() == ["t1", "t2", "t3", "t4", "t5", "t6"] and feeds.ask_again(spark, box.root).isEmpty()
    # Folding the log keeps positions and what was put aside.
    target = scratch(spark, "compact")
    sync.compact(spark, box.root, target)
    assert rows(feeds.positions(spark, target)) == rows(feeds.positions(spark, box.root))
    assert feeds.quarantined(spark, target).count() == 1


def test_a_failing_source_is_held_whole(box):
    box.down = ["a"]
    box.run(page("a", 1, "t1"), page("a", 2, "t2"), page("b", 1, "t3"))
    assert box.at() == {"a": (None, 1), "b": (1, None)} and box.threads() == ["t3"]
    box.down = []
    box.run(page("a", 1, "t1"), page("a", 2, "t2"))
    assert box.at() == {"a": (2, None), "b": (1, None)} and box.threads() == ["t1", "t2", "t3"]


def test_positions_are_stored_after_the_rows(box):
    box.fail = True
    with pytest.raises(Exception, match="unreachable"):
        box.run(page("a", 1, "t1"))
    assert box.at() == {}
    box.fail = False
    box.run()
    assert box.at() == {"a": (1, None)} and box.threads() == ["t1"]


def test_a_replayed_batch_writes_the_same_positions(box, spark):
    pages = spark.createDataFrame([page("a", 1, "t1"), ("u", "a", None, 2), page("a", 3, "t3")], feeds.PAGES)
    for _ in range(2):
        feeds.apply_pages(pages, 0, box.root, box.mailbox, "x")
        assert box.at() == {"a": (1, 2)} and box.threads() == ["t1"]
    assert rows(feeds.quarantined(spark, box.root), "seq", "error") == [(2, "no payload")]


def test_a_checkpoint_started_over_counts_on(box):
    """A batch that stored positions alone still takes a number of its own."""
    box.run(("u", "a", "no page", 1))
    assert box.at() == {"a": (None, 1)} and box.threads() == []
    box.run(page("a", 1, "t1"), checkpoint=scratch(box.spark, "cursor"))
    # The new checkpoint reads all pages; the readable copy of page 1 counts.
    assert box.at() == {"a": (1, None)} and box.threads() == ["t1"]


def test_stops_on_odd_pages(spark):
    """Repeated, unnumbered and late pages; null sources and an empty batch."""
    judged = lambda *p: feeds.judged(spark.createDataFrame(list(p), feeds.PAGES), *feeds.FORMATS["delta"][:1])
    known = spark.createDataFrame([("u", "a", 9, None), ("u", "b", 9, 4)], sync.CURSORS)
    empty = feeds.stops(judged(), known)
    assert rows(empty) == [("u", "b", 9, 4)]
    got = feeds.stops(judged(
        page("a", 2, "t1"), ("u", "a", "bad", 5), page("a", 5, "t1"), ("u", "a", "bad", None),
        page("b", 3, "t1"), page("b", 12, "t1"), ("u", "c", "bad", 1), ("u", "c", "bad", 1)), known)
    assert rows(got) == [("u", "a", 9, None), ("u", "b", 9, 4), ("u", "c", None, 1)]
