"""Mutations, access, usage and job state on small rows."""

from pyspark.sql import functions as F

from helpers import rows
from threadlens.operators import mutate, state, usage

T = ("user_id string, thread_id string, subject string, date_first string, date_last string, "
     "n_messages bigint, ai_tags array<string>, user_tags array<string>, manually_reviewed boolean")


def thread(i, user="u", subject="s", last="2020", tags=("a",), own=("o",)):
    return (user, i, subject, "2019", last, 1, list(tags), list(own), False)


def test_upsert_keeps_and_replaces(spark):
    cur = spark.createDataFrame([thread("k"), thread("k", "v"), thread("only")], T)
    new = spark.createDataFrame([thread("k", subject="n", last="2021", tags=(), own=("x",)),
                                 thread("new", tags=("z",))], T)
    got = mutate.upsert_threads(cur, new)
    assert rows(got, "user_id", "thread_id", "subject", "date_last", "ai_tags", "user_tags") == [
        ("u", "k", "s", "2021", ["a"], ["o"]), ("u", "new", "s", "2020", ["z"], ["o"]),
        ("u", "only", "s", "2020", ["a"], ["o"]), ("v", "k", "s", "2020", ["a"], ["o"])]
    assert rows(mutate.upsert_threads(cur, new, refresh_headers=True).filter("thread_id = 'k' and user_id = 'u'"),
                "subject") == [("n",)]


def test_import_rules(spark):
    cur = spark.createDataFrame([thread("k"), thread("gone"), thread("k", "v")], T)
    file = spark.createDataFrame([(*thread("k", subject="1", tags=("first",)), 1),
                                  (*thread("k", subject="2", tags=(), own=("theirs",)), 2)], T + ", row_no bigint")
    inc = mutate.collapse_import(file)
    assert rows(inc, "subject", "ai_tags", "user_tags") == [("2", ["first"], ["theirs"])]
    assert rows(mutate.import_merge(cur, inc), "user_id", "thread_id", "subject", "user_tags") == [
        ("u", "gone", "s", ["o"]), ("u", "k", "2", ["theirs"]), ("v", "k", "s", ["o"])]
    assert rows(mutate.import_merge(cur, inc, replace="u"), "user_id", "thread_id") == [("u", "k"), ("v", "k")]


def test_claim(spark):
    t = spark.createDataFrame([thread("a", "old"), thread("b", "old"), thread("c", "old"),
                               thread("c", "me", subject="mine"), thread("d", "other")], T)
    assert rows(mutate.claim_counts(t, "old", "me")) == [(2, 1)]
    assert rows(mutate.claim(t, "old", "me"), "user_id", "thread_id", "subject") == [
        ("me", "a", "s"), ("me", "b", "s"), ("me", "c", "mine"), ("old", "c", "s"), ("other", "d", "s")]
    assert mutate.claim(t, "old", "me", drop_duplicates=True).filter("user_id = 'old'").isEmpty()
    summary, oldest = mutate.tenant_summary(t, "old")
    assert rows(summary) == [(3, "2019", "2020")] and oldest.count() == 3


def test_delete_wipe_and_lookup(spark):
    t = spark.createDataFrame([thread("a"), thread("b"), thread("a", "v")], T)
    gone = spark.createDataFrame([("u", "a")], "user_id string, thread_id string")
    assert rows(mutate.delete(t, gone), "user_id", "thread_id") == [("u", "b"), ("v", "a")]
    assert rows(mutate.wipe(t, gone), "user_id") == [("v",)]
    users = spark.createDataFrame([("u", "Ann@X.com"), ("v", None)], "user_id string, email string")
    asked = spark.createDataFrame([("ann@x.COM",), (None,)], "email string")
    assert rows(mutate.users_by_email(users, asked), "user_id") == [("u",)]
    old = t.drop("user_id").filter("thread_id = 'b'")
    assert rows(mutate.adopt_untenanted(old, t.filter("user_id = 'v'")), "user_id", "thread_id") == [
        ("__unclaimed__", "b"), ("v", "a")]


def test_access_life(spark):
    shape = ("user_id string, email string, status string, requested_at string, decided_at string, "
             "denied_until string, notified_at string")
    tries = spark.createDataFrame([(u, f"{u}@x", "2024-01-01 00:00:00", 1) for u in "abcd"],
                                  "user_id string, email string, now string, seq int")
    req = mutate.access_requests(spark.createDataFrame([], shape), tries)
    dec = spark.createDataFrame([("a", "approve", "2024-01-01 10:00:00"), ("b", "deny", "2024-01-01 10:00:00"),
                                 ("c", "revoke", "2024-01-01 10:00:00")],
                                "user_id string, decision string, decided string")
    req = mutate.decide(req, dec)
    at = lambda now: [r[1] for r in rows(mutate.access_state(req, now), "user_id", "state")]
    assert at("2024-01-01 10:59:59") == ["approved", "cooldown", "reopened", "pending"]
    assert at("2024-01-01 11:00:00") == ["approved", "reopened", "reopened", "pending"]
    again = mutate.reopen(req, "2024-01-01 11:00:00")
    assert [r[1] for r in rows(again, "user_id", "status")] == ["approved", "pending", "pending", "pending"]
    kept = mutate.access_requests(req, tries.withColumn("now", F.lit("2025")))
    assert rows(kept, "status", "requested_at")[0] == ("approved", "2025")
    note = spark.createDataFrame([("a", "2025")], "user_id string, now string")
    assert rows(mutate.mark_notified(req, note), "user_id", "notified_at")[:2] == [("a", "2025"), ("b", None)]
    assert [r["status"] for r in mutate.access_queue(req).collect()] == ["pending", "denied", "denied", "approved"]
    assert mutate.access_queue(req, "denied").count() == 2


def test_users(spark):
    shape = "user_id string, email string, display_name string, first_seen string, last_seen string"
    users = spark.createDataFrame([("a", "old", "A", "1", "1")], shape)
    logins = spark.createDataFrame([("a", "new", "A2", "5", 1), ("a", "newer", "A3", "6", 2), ("b", "b", "B", "7", 3)],
                                   "user_id string, email string, display_name string, now string, seq int")
    assert rows(mutate.upsert_users(users, logins)) == [("a", "newer", "A3", "1", "6"), ("b", "b", "B", "7", "7")]


def test_usage_and_spend(spark):
    daily = spark.createDataFrame(
        [("a", "2024-01-31", False, 5, 10**9, 0, 0), ("a", "2024-02-01", True, 1, 10**6, 0, 0),
         ("a", "2024-02-03", False, 1, 0, 10**6, 0), ("gone", "2024-02-02", False, 1, 1, 1, 0),
         ("boss", "2024-02-02", False, 1, 10**9, 0, 0)],
        "user_id string, day string, batched boolean, requests bigint, input_tokens bigint, output_tokens bigint, "
        "cache_read_tokens bigint")
    users = spark.createDataFrame([("a", "a@x"), ("boss", "Boss@x"), ("new", "n@x")], "user_id string, email string")
    assert [r[0] for r in rows(usage.usage_by_user(daily, users), "user_id")] == ["a", "boss"]
    s = usage.spend_status(daily, users, "2024-02-01", 4.5, ["boss@X"])
    assert rows(s, "user_id", "spent", "over_limit") == [("a", 4.5, True), ("boss", 1000.0, False), ("new", 0.0, False)]
    assert not usage.spend_status(daily, users, "2024-02-01", None, []).filter("over_limit").count()


def test_state(spark):
    ev = spark.createDataFrame(
        [("a", "progress_status", "done", 1), ("a", "progress_status", "tagging", 3), ("a", "progress_current", "2", 4),
         ("a", "progress_total", "8", 5), ("a", "progress_updated", "1000", 6), ("b", "progress_current", "x", 1),
         ("c", "progress_status", "retagging", 1), ("d", "stop", "1", 1)],
        "user_id string, key string, value string, seq bigint")
    st = state.latest_state(ev)
    assert rows(st) == [("a", 2, 8, "tagging", 1000.0), ("b", 0, 0, "idle", None), ("c", 0, 0, "retagging", None)]
    flag = lambda now: [r[1] for r in rows(state.stale(st, now), "user_id", "stale")]
    assert flag(1300) == [False, False, True] and flag(1300.5) == [True, False, True]
    assert rows(state.interrupt(st), "user_id", "status") == [("a", "interrupted"), ("b", "idle"), ("c", "interrupted")]
    assert rows(state.progress(st, F.lit(60.0)), "percent", "seconds_left") == [(25, 180), (None, None), (None, None)]


def test_batches_and_snapshots(spark):
    ev = spark.createDataFrame(
        [("a", "b1", "submitted", "2024-01-01T00:00:00", 1), ("a", "b2", "submitted", "2024-01-01T00:00:00", 2),
         ("a", "b2", "ended", None, 3), ("c", "b3", "submitted", "2024-01-01T00:00:00", 4),
         ("c", "b3", "unknown", None, 5), ("c", "b4", "submitted", "2024-01-20T00:00:00", 6),
         ("c", "b4", "unknown", None, 7)],
        "user_id string, batch_id string, status string, submitted_at string, seq bigint")
    now = lambda s: F.lit(s).cast("timestamp")
    assert rows(state.open_batches(ev, now("2024-01-31 00:00:00")), "batch_id") == [("b1",), ("b4",)]
    assert rows(state.open_batches(ev, now("2024-01-30 23:59:59")), "batch_id") == [("b1",), ("b3",), ("b4",)]
    v = spark.sql("SELECT 's' AS set_id, 1 AS version, timestamp'2024-01-01 00:00:00' AS taken")
    due = lambda at, h=24: state.snapshot_due(v, h, now(at)).first()["due"]
    assert due("2024-01-02 00:00:00") and not due("2024-01-01 23:59:59") and not due("2030-01-01 00:00:00", 0)
