"""Queries over table changes, usage, access, job state and the sync stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import values
from threadlens.operators import mutate, state, usage
from threadlens.plans.common import CHAT_SQL, EXCLUDED, chat_threads, header_sql, sql_tokens
from threadlens.plans.registry import query
from threadlens.schemas import CHANGES, KEY, THREADS
from threadlens.session import materialise, scratch
from threadlens.sources import adapters, store
from threadlens.streaming import feeds, sync, usage as usage_streams

SHOW = ["user_id", "thread_id", "subject", "date_first", "date_last", "tags", "own_tags", "reviewed"]


def _orders(spark, sf):
    """(current, incoming): two overlapping halves of the orders as threads."""
    o = adapters.mapped(spark, sf, "order_threads")
    k = F.col("o_orderkey")
    empty = F.array().cast("array<string>")
    one = F.when(F.col("tag_1") == "", empty).otherwise(F.array("tag_1"))
    base = o.select(
        *KEY, "subject", "date_first", "date_last", F.col("amount").alias("n_messages"),
        "o_orderkey", one.alias("ai_tags"), F.array(F.lit("mine")).alias("user_tags"),
        F.lit(False).alias("manually_reviewed"), F.lit(False).alias("tags_truncated"),
    )
    current = base.filter(k % 3 != 2).drop("o_orderkey")
    incoming = base.filter(k % 3 != 0).withColumns({
        "subject": F.concat(F.lit("new "), "subject"), "date_first": F.lit("2000-01-01"),
        "date_last": F.lit("2030-01-01"),
        "ai_tags": F.when(k % 2 == 0, F.array(F.lit("fresh"))).otherwise(empty),
        "user_tags": F.array(F.lit("theirs")), "manually_reviewed": F.lit(True),
        "tags_truncated": F.lit(True),
    }).drop("o_orderkey")
    return current, incoming


def _shown(df):
    return df.select(
        *KEY, "subject", "date_first", "date_last", F.array_join("ai_tags", "|").alias("tags"),
        F.array_join("user_tags", "|").alias("own_tags"), F.col("manually_reviewed").alias("reviewed"),
    )


_UPSERT_SQL = """
    SELECT user_id, thread_id,
           CASE WHEN k = 2 {import_1} THEN 'new ' || subject ELSE subject END AS subject,
           CASE WHEN k = 2 {import_1} THEN '2000-01-01' ELSE date_first END AS date_first,
           CASE WHEN k IN (1, 2) THEN '2030-01-01' ELSE date_last END AS date_last,
           CASE WHEN k IN (1, 2) AND o_orderkey % 2 = 0 AND {with_tags} THEN 'fresh'
                WHEN k = 2 THEN '' ELSE tag_1 END AS tags,
           CASE WHEN k = 2 {import_1} THEN 'theirs' ELSE 'mine' END AS own_tags,
           CASE WHEN k = 2 {import_1} THEN true ELSE false END AS reviewed
    FROM (SELECT *, o_orderkey % 3 AS k FROM {order_threads})
"""


def _upsert_sql(is_import: bool, with_tags: bool = True) -> str:
    return _UPSERT_SQL.replace("{import_1}", "OR k = 1" if is_import else "").replace(
        "{with_tags}", "true" if with_tags else "false"
    )


@query("upsert_threads", _upsert_sql(False))
def upsert_threads(spark, sf):
    return _shown(mutate.upsert_threads(*_orders(spark, sf)))


@query("store_untagged", _upsert_sql(False, with_tags=False))
def store_untagged(spark, sf):
    return _shown(mutate.store_untagged(*_orders(spark, sf)))


@query("import_merge", _upsert_sql(True))
def import_merge(spark, sf):
    return _shown(mutate.import_merge(*_orders(spark, sf)))


@query("import_threads", """
    SELECT user_id, thread_id, subject FROM {order_threads} WHERE o_orderkey % 3 <> 2 AND user_id <> 'c1'
    UNION ALL
    SELECT 'c1', thread_id, 'new ' || subject FROM {order_threads} WHERE o_orderkey % 3 <> 0
""")
def import_threads(spark, sf):
    """A file with repeated threads, read and imported in replace mode: the tenant loses the rows it had."""
    current, incoming = _orders(spark, sf)
    path = scratch(spark, "import")
    stale = incoming.withColumn("subject", F.lit("stale"))
    lines = stale.withColumn("at", F.lit(0)).unionByName(incoming.withColumn("at", F.lit(1)))
    whole = {c.split()[0]: c.split()[1] for c in THREADS.replace("\n", " ").split(", ") if c.strip()}
    filled = lines.select(*[
        (F.col(c) if c in lines.columns else F.lit(None).cast(kind)).alias(c) for c, kind in whole.items()
    ], "at", F.lit(None).cast("boolean").alias("attachments_scanned"))
    ordered = filled.repartitionByRange("at", "thread_id").sortWithinPartitions("at", "thread_id")
    store.export_threads({"threads": ordered.drop("at")}, path)
    rows = store.read_export(spark, path, "c1")
    return mutate.import_file(current, rows, "c1").select(*KEY, "subject")


@query("w_last_nonempty", """
    SELECT thread_id, max(event_id) AS last_row,
           coalesce(max_by(event_type, event_id) FILTER (event_id % 3 <> 0), '') AS tags
    FROM (SELECT *, 't' || CAST(user_id AS VARCHAR) AS thread_id FROM events) GROUP BY ALL
""")
def w_last_nonempty(spark, sf):
    e = adapters.table(spark, sf, "events")
    k = F.col("event_id")
    rows = e.select(
        F.lit("u").alias("user_id"), F.concat(F.lit("t"), "user_id").alias("thread_id"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("ai_tags"),
        k.alias("last_row"), k.alias("row_no"),
    )
    return mutate.collapse_import(rows).select(
        "thread_id", "last_row", F.array_join("ai_tags", "|").alias("tags")
    )


@query("delete_threads", """
    SELECT user_id, thread_id FROM {order_threads} WHERE o_orderkey NOT IN (
        SELECT event_id * 2 FROM events WHERE event_type = 'error')
""")
def delete_threads(spark, sf):
    o = adapters.mapped(spark, sf, "order_threads")
    gone = adapters.table(spark, sf, "events").filter("event_type = 'error'").select(
        (F.col("event_id") * 2).alias("o_orderkey")
    )
    return mutate.delete(o, o.join(gone, "o_orderkey", "left_semi")).select(*KEY)


@query("wipe_user", """
    SELECT user_id, count(*) AS threads FROM {order_threads}
    WHERE user_id NOT IN (SELECT 'c' || CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'view')
    GROUP BY ALL
""")
def wipe_user(spark, sf):
    e = adapters.table(spark, sf, "events").filter("event_type = 'view'")
    users = e.select(F.concat(F.lit("c"), "user_id").alias("user_id"))
    left = mutate.wipe(adapters.mapped(spark, sf, "order_threads"), users)
    return left.groupBy("user_id").agg(F.count("*").alias("threads"))


@query("upsert_users", """
    WITH logins AS (
        SELECT 'c' || CAST(user_id AS VARCHAR) AS user_id, min(event_id) AS lo, max(event_id) AS hi
        FROM events GROUP BY ALL)
    SELECT coalesce(u.user_id, l.user_id) AS user_id,
           CASE WHEN l.user_id IS NOT NULL THEN 'e' || CAST(hi AS VARCHAR) || '@mail.example' ELSE email END AS email,
           CASE WHEN u.user_id IS NOT NULL THEN 'start' ELSE CAST(lo AS VARCHAR) END AS first_seen,
           CASE WHEN l.user_id IS NOT NULL THEN CAST(hi AS VARCHAR) ELSE 'start' END AS last_seen
    FROM (SELECT * FROM {users} WHERE segment <> 'BUILDING') u FULL JOIN logins l ON u.user_id = l.user_id
""")
def upsert_users(spark, sf):
    u = adapters.mapped(spark, sf, "users").filter("segment <> 'BUILDING'")
    users = u.select("user_id", "email", "display_name", F.lit("start").alias("first_seen"),
                     F.lit("start").alias("last_seen"))
    e = adapters.table(spark, sf, "events")
    logins = e.select(
        F.concat(F.lit("c"), "user_id").alias("user_id"),
        F.concat(F.lit("e"), "event_id", F.lit("@mail.example")).alias("email"),
        F.lit("x").alias("display_name"), F.col("event_id").cast("string").alias("now"),
        F.col("event_id").alias("seq"),
    )
    return mutate.upsert_users(users, logins).select("user_id", "email", "first_seen", "last_seen")


@query("user_by_email", """
    SELECT user_id, email FROM {users} WHERE lower(email) IN (
        SELECT lower('CUSTOMER#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@customer.EXAMPLE') FROM events)
""")
def user_by_email(spark, sf):
    emails = adapters.table(spark, sf, "events").select(
        F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("user_id").cast("string"), 9, "0"),
                 F.lit("@customer.EXAMPLE")).alias("email")
    )
    return mutate.users_by_email(adapters.mapped(spark, sf, "users"), emails).select("user_id", "email")


# Tenants -------------------------------------------------------------------------

_TWO_TENANTS = """
    two AS (
        SELECT 'old' AS user_id, thread_id, subject, date_first, date_last FROM {order_threads}
        WHERE o_orderkey % 3 <> 2
        UNION ALL SELECT 'new', thread_id, 'own ' || subject, date_first, date_last FROM {order_threads}
        WHERE o_orderkey % 4 = 0),
    both_have AS (SELECT thread_id FROM two GROUP BY ALL HAVING count(*) = 2)
"""


def _two_tenants(spark, sf):
    o = adapters.mapped(spark, sf, "order_threads")
    k = F.col("o_orderkey")
    cols = ["thread_id", "subject", "date_first", "date_last"]
    old = o.filter(k % 3 != 2).select(F.lit("old").alias("user_id"), *cols)
    new = o.filter(k % 4 == 0).withColumn("subject", F.concat(F.lit("own "), "subject")).select(
        F.lit("new").alias("user_id"), *cols
    )
    return old.unionByName(new)


@query("j_legacy_collisions", f"WITH {_TWO_TENANTS} SELECT thread_id FROM both_have")
def j_legacy_collisions(spark, sf):
    return mutate.claim_collisions(_two_tenants(spark, sf), "old", "new")


@query("j_legacy_claim", f"""
    WITH {_TWO_TENANTS}
    SELECT 'new' AS user_id, thread_id, subject FROM two
    WHERE user_id = 'new' OR thread_id NOT IN (SELECT thread_id FROM both_have)
""")
def j_legacy_claim(spark, sf):
    return mutate.claim(_two_tenants(spark, sf), "old", "new", drop_duplicates=True).select(*KEY, "subject")


@query("claim_counts", f"""
    WITH {_TWO_TENANTS}
    SELECT count(nullif(thread_id NOT IN (SELECT thread_id FROM both_have), false)) AS moved,
           (SELECT count(*) FROM both_have) AS duplicates
    FROM two WHERE user_id = 'old'
""")
def claim_counts(spark, sf):
    return mutate.claim_counts(_two_tenants(spark, sf), "old", "new")


@query("legacy_summary", f"""
    WITH {_TWO_TENANTS}
    SELECT count(*) AS threads, min(date_first) AS oldest, max(date_last) AS newest FROM two
    WHERE user_id = 'old'
""")
def legacy_summary(spark, sf):
    return mutate.tenant_summary(_two_tenants(spark, sf), "old")[0]


@query("legacy_oldest", f"""
    WITH {_TWO_TENANTS}
    SELECT thread_id, subject, date_first FROM two WHERE user_id = 'old'
    ORDER BY date_first, thread_id LIMIT 8
""")
def legacy_oldest(spark, sf):
    return mutate.tenant_summary(_two_tenants(spark, sf), "old")[1]


@query("migrate_tenant", """
    SELECT CASE WHEN o_orderkey % 2 = 0 THEN '__unclaimed__' ELSE user_id END AS user_id, thread_id,
           CASE WHEN o_orderkey % 2 = 1 THEN amount END AS amount
    FROM {order_threads}
""")
def migrate_tenant(spark, sf):
    o = adapters.mapped(spark, sf, "order_threads")
    old = o.filter("o_orderkey % 2 = 0").select("thread_id")
    current = o.filter("o_orderkey % 2 = 1").select(*KEY, "amount")
    return mutate.adopt_untenanted(old, current)


# Access --------------------------------------------------------------------------

_ACCESS_NOW = "2024-01-20 12:00:00"
_ACCESS_SQL = f"""
    asked AS (
        SELECT 'c' || CAST(user_id AS VARCHAR) AS user_id,
               max(substring(CAST(ts AS VARCHAR), 1, 19)) AS requested_at FROM events GROUP BY ALL),
    ruled AS (
        SELECT 'c' || CAST(user_id AS VARCHAR) AS user_id, max_by(event_type, event_id) AS what,
               max_by(substring(CAST(ts AS VARCHAR), 1, 19), event_id) AS ruled_at
        FROM events WHERE event_type IN ('view', 'click', 'error')
          AND ts <= TIMESTAMP '{_ACCESS_NOW}' GROUP BY ALL),
    access AS (
        SELECT a.user_id, requested_at,
               CASE what WHEN 'view' THEN 'approved' WHEN 'click' THEN 'denied' WHEN 'error' THEN 'denied'
                    ELSE 'pending' END AS status,
               ruled_at AS decided_at,
               CASE WHEN what = 'click' THEN strftime(CAST(ruled_at AS TIMESTAMP) + INTERVAL 720 MINUTE,
                    '%Y-%m-%d %H:%M:%S') END AS denied_until
        FROM asked a LEFT JOIN ruled USING (user_id))
"""


def _access(spark, sf):
    e = adapters.table(spark, sf, "events")
    stamp = F.substring(F.col("ts").cast("string"), 1, 19)
    user = F.concat(F.lit("c"), "user_id").alias("user_id")
    none = spark.createDataFrame(
        [], "user_id string, email string, status string, requested_at string, decided_at string, "
        "denied_until string, notified_at string",
    )
    attempts = e.select(user, F.lit("e").alias("email"), stamp.alias("now"), F.col("event_id").alias("seq"))
    word = F.when(F.col("event_type") == "view", "approve").when(
        F.col("event_type") == "click", "deny").otherwise("revoke")
    ruled = e.filter(F.col("event_type").isin("view", "click", "error") & (stamp < _ACCESS_NOW)).select(
        user, word.alias("decision"), stamp.alias("decided"), "event_id"
    )
    # Every decision, in any order; the last one of a user counts.
    decisions = ruled.drop("event_id")
    return mutate.decide(mutate.access_requests(none, attempts), decisions, cooldown_minutes=720)


@query("set_decision", f"""
    WITH {_ACCESS_SQL} SELECT user_id, status, requested_at, decided_at, denied_until FROM access
""")
def set_decision(spark, sf):
    return _access(spark, sf).select("user_id", "status", "requested_at", "decided_at", "denied_until")


@query("upsert_access", f"""
    WITH {_ACCESS_SQL}
    SELECT user_id, status, '2024-02-02' AS requested_at, decided_at FROM access
    UNION ALL SELECT 'stranger', 'pending', '2024-02-02', NULL
""")
def upsert_access(spark, sf):
    """A second sign-in of everybody: decisions are kept, strangers are pending."""
    rows = _access(spark, sf)
    stranger = spark.createDataFrame([("stranger",)], "user_id string")
    again = rows.select("user_id").unionByName(stranger).select(
        "user_id", F.lit("e").alias("email"), F.lit("2024-02-02").alias("now"), F.lit(1).alias("seq")
    )
    return mutate.access_requests(rows, again).select("user_id", "status", "requested_at", "decided_at")


@query("access_state", f"""
    WITH {_ACCESS_SQL}
    SELECT user_id, CASE WHEN status = 'approved' THEN 'approved'
        WHEN status = 'denied' AND denied_until > '{_ACCESS_NOW}' THEN 'cooldown'
        WHEN status = 'denied' THEN 'reopened' ELSE 'pending' END AS state FROM access
""")
def access_state(spark, sf):
    return mutate.access_state(_access(spark, sf), _ACCESS_NOW).select("user_id", "state")


@query("sort_status_rank", f"""
    WITH {_ACCESS_SQL}
    SELECT user_id, status, requested_at FROM access
    ORDER BY CASE status WHEN 'pending' THEN 0 WHEN 'denied' THEN 1 ELSE 2 END, requested_at DESC, user_id
""")
def sort_status_rank(spark, sf):
    return mutate.access_queue(_access(spark, sf)).select("user_id", "status", "requested_at")


# Usage ---------------------------------------------------------------------------

_DAILY = """
    daily AS (
        SELECT user_id, day, batched, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens,
               sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens
        FROM {usage_events} GROUP BY ALL)
"""
_TOTALS = """
    SELECT user_id, sum(requests)::BIGINT AS requests, sum(input_tokens)::BIGINT AS input_tokens,
           sum(output_tokens)::BIGINT AS output_tokens,
           sum(CASE WHEN batched THEN requests ELSE 0 END)::BIGINT AS batched_requests
"""
_COST = """(input_tokens / 1e6 + output_tokens / 1e6 * 5) * (1 - 0.5 * batched_requests / requests)"""


def _daily(spark, sf):
    return usage.usage_daily(adapters.mapped(spark, sf, "usage_events"))


@query("record_usage", f"WITH {_DAILY} SELECT * FROM daily")
def record_usage(spark, sf):
    return _daily(spark, sf)


@query("usage_by_user", f"""
    WITH {_DAILY}, t AS ({_TOTALS} FROM daily GROUP BY user_id)
    SELECT t.*, u.email, round({_COST}, 9) AS cost FROM t JOIN {{users}} u USING (user_id)
""")
def usage_by_user(spark, sf):
    u = usage.usage_by_user(_daily(spark, sf), adapters.mapped(spark, sf, "users"))
    return u.withColumn("cost", F.round("cost", 9))


@query("j_usage_users", f"""
    WITH {_DAILY} SELECT d.user_id, d.day, d.batched, d.requests FROM daily d
    JOIN {{users}} u USING (user_id) WHERE u.segment <> 'BUILDING'
""")
def j_usage_users(spark, sf):
    u = adapters.mapped(spark, sf, "users").filter("segment <> 'BUILDING'").select("user_id")
    return _daily(spark, sf).join(u, "user_id").select("user_id", "day", "batched", "requests")


@query("usage_since", f"WITH {_DAILY} {_TOTALS} FROM daily WHERE day >= '2024-01-15' GROUP BY user_id")
def usage_since(spark, sf):
    return usage.usage_since(_daily(spark, sf), "2024-01-15")


@query("estimate_cost", """
    SELECT event_id, round((event_id * 1000 / 1e6 + floor(value) * 100 / 1e6 * 5)
        * (1 - 0.5 * CASE WHEN event_id % 5 = 0 THEN 0 ELSE (event_id % 3) / (event_id % 5) END), 9) AS cost
    FROM events
""")
def estimate_cost(spark, sf):
    k = F.col("event_id")
    c = values.cost(k % 5, k % 3, k * 1000, F.floor("value") * 100)
    return adapters.table(spark, sf, "events").select("event_id", F.round(c, 9).alias("cost"))


@query("spend_limit", f"""
    WITH {_DAILY}, t AS ({_TOTALS} FROM daily WHERE day >= '2024-01-10' GROUP BY user_id),
    s AS (SELECT u.user_id, u.email, CASE WHEN t.user_id IS NULL THEN 0.0 ELSE {_COST} END AS spent
          FROM {{users}} u LEFT JOIN t USING (user_id))
    SELECT user_id, email, round(spent, 9) AS spent,
           spent >= 0.5 AND lower(email) <> 'customer#000000001@customer.example' AS over_limit FROM s
""")
def spend_limit(spark, sf):
    s = usage.spend_status(
        _daily(spark, sf), adapters.mapped(spark, sf, "users"), "2024-01-10", 0.5,
        ["CUSTOMER#000000001@customer.example"],
    )
    return s.withColumn("spent", F.round("spent", 9))


@query("month_start", """
    SELECT user_id, substring(day, 1, 7) || '-01' AS month, count(*) AS requests FROM {usage_events}
    GROUP BY ALL
""")
def month_start(spark, sf):
    e = adapters.mapped(spark, sf, "usage_events")
    return e.groupBy("user_id", values.month_start(F.col("ts")).alias("month")).agg(
        F.count("*").alias("requests")
    )


_UNTAGGED = """
    SELECT o.user_id, coalesce(u.email, o.user_id) AS email, count(*) AS untagged
    FROM {order_threads} o LEFT JOIN (SELECT * FROM {users} WHERE segment <> 'MACHINERY') u USING (user_id)
    WHERE o.tag_1 = '' GROUP BY ALL
"""


def _order_tags(spark, sf):
    o = adapters.mapped(spark, sf, "order_threads")
    none = F.array().cast("array<string>")
    return o.withColumn("ai_tags", F.when(F.col("tag_1") == "", none).otherwise(F.array("tag_1")))


@query("untagged_by_user", _UNTAGGED + " ORDER BY untagged DESC, o.user_id")
def untagged_by_user(spark, sf):
    users = adapters.mapped(spark, sf, "users").filter("segment <> 'MACHINERY'")
    return usage.untagged_by_user(_order_tags(spark, sf), users)


@query("j_untagged_users", f"""
    SELECT count(*) AS users, count(nullif(email = user_id, false)) AS unknown, sum(untagged)::BIGINT AS untagged
    FROM ({_UNTAGGED})
""")
def j_untagged_users(spark, sf):
    users = adapters.mapped(spark, sf, "users").filter("segment <> 'MACHINERY'")
    return usage.untagged_by_user(_order_tags(spark, sf), users).agg(
        F.count("*").alias("users"), F.count_if(F.col("email") == F.col("user_id")).alias("unknown"),
        F.sum("untagged").alias("untagged"),
    )


@query("count_threads", """
    SELECT user_id, count(*) AS threads, count(nullif(tag_1 = '', false)) AS untagged FROM {order_threads} GROUP BY ALL
""")
def count_threads(spark, sf):
    return usage.counts(_order_tags(spark, sf))


@query("describe_counts", f"""
    WITH {CHAT_SQL}
    SELECT count(*) AS threads, count(nullif(len(ai_tags) > 0, false)) AS tagged,
           (SELECT count(*) FROM customer) AS users FROM chat
""")
def describe_counts(spark, sf):
    return usage.describe_counts(chat_threads(spark, sf)[0], adapters.mapped(spark, sf, "users"))


# State ---------------------------------------------------------------------------

_LATEST = """
    latest AS (
        SELECT user_id, coalesce(max_by(value, seq) FILTER (key = 'progress_current'), '0')::BIGINT AS current,
               coalesce(max_by(value, seq) FILTER (key = 'progress_total'), '0')::BIGINT AS total,
               coalesce(max_by(value, seq) FILTER (key = 'progress_status'), 'idle') AS status,
               max_by(value, seq) FILTER (key = 'progress_updated')::DOUBLE AS updated
        FROM {state_events} GROUP BY user_id)
"""
_ACTIVE = "status IN ('processing', 'tagging', 'updating threads')"


def _latest(spark, sf):
    return state.latest_state(adapters.mapped(spark, sf, "state_events"))


@query("kv_latest", f"WITH {_LATEST} SELECT * FROM latest")
def kv_latest(spark, sf):
    return _latest(spark, sf)


@query("stale_sync", f"""
    WITH {_LATEST}
    SELECT user_id, status, {_ACTIVE} AND coalesce(1706500000 - updated > 300, true) AS stale FROM latest
""")
def stale_sync(spark, sf):
    return state.stale(_latest(spark, sf), 1706500000).select("user_id", "status", "stale")


@query("interrupted_syncs", f"""
    WITH {_LATEST}
    SELECT user_id, CASE WHEN {_ACTIVE} THEN 'interrupted' ELSE status END AS status,
           {_ACTIVE} AS was_active FROM latest
""")
def interrupted_syncs(spark, sf):
    return state.interrupt(_latest(spark, sf)).select("user_id", "status", "was_active")


@query("p_progress", f"""
    WITH {_LATEST}
    SELECT user_id, CASE WHEN total > 0 THEN floor(current * 100.0 / total + 0.5)::BIGINT END AS percent,
           CASE WHEN total > 0 AND current > 0
                THEN floor((total - current) * 120.0 / current + 0.5)::BIGINT END AS seconds_left
    FROM latest
""")
def p_progress(spark, sf):
    return state.progress(_latest(spark, sf), F.lit(120.0)).select("user_id", "percent", "seconds_left")


_BATCH_NOW = "2024-02-10 00:00:00"
_OPEN = f"""
    open AS (
        SELECT user_id, batch_id, max_by(status, seq) AS status, min_by(submitted_at, seq) AS submitted_at
        FROM {{batch_events}} GROUP BY ALL
        HAVING max_by(status, seq) <> 'ended' AND NOT (max_by(status, seq) = 'unknown'
            AND floor(epoch(TIMESTAMP '{_BATCH_NOW}' - CAST(min_by(submitted_at, seq) AS TIMESTAMP)) / 86400) > 29))
"""


def _open(spark, sf):
    return state.open_batches(
        adapters.mapped(spark, sf, "batch_events"), F.lit(_BATCH_NOW).cast("timestamp")
    )


@query("batch_ledger", f"WITH {_OPEN} SELECT * FROM open")
def batch_ledger(spark, sf):
    return _open(spark, sf)


@query("users_with_batches", f"WITH {_OPEN} SELECT DISTINCT user_id FROM open")
def users_with_batches(spark, sf):
    return state.users_with_batches(_open(spark, sf))


@query("batch_expired", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN false ELSE
        floor(epoch(TIMESTAMP '2024-02-10 00:00:00' - CAST(substring(CAST(ts AS VARCHAR), 1, 19) AS TIMESTAMP))
              / 86400) > 29 END AS expired
    FROM events
""")
def batch_expired(spark, sf):
    e = adapters.table(spark, sf, "events")
    stamp = F.substring(F.col("ts").cast("string"), 1, 19)
    k = F.col("event_id") % 4
    text = F.when(k == 0, "not a date").when(k == 1, F.concat(F.replace(stamp, F.lit(" "), F.lit("T")),
                                                             F.lit("+00:00"))).otherwise(stamp)
    return e.select("event_id", values.expired(text, F.lit(_BATCH_NOW).cast("timestamp")).alias("expired"))


@query("snapshot_due", """
    SELECT 's' || CAST(user_id AS VARCHAR) AS set_id,
           epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts)) >= 24 * 3600 AS due
    FROM events GROUP BY ALL
""")
def snapshot_due(spark, sf):
    e = adapters.table(spark, sf, "events")
    versions = e.select(F.concat(F.lit("s"), "user_id").alias("set_id"), F.col("ts").cast("timestamp").alias("taken"))
    return state.snapshot_due(versions, 24, F.lit("2024-01-31 00:00:00").cast("timestamp")).select(
        "set_id", "due"
    )


@query("w_keep_newest", """
    SELECT 's' || CAST(user_id AS VARCHAR) AS set_id, event_id AS version FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 7
""")
def w_keep_newest(spark, sf):
    e = adapters.table(spark, sf, "events")
    versions = e.select(F.concat(F.lit("s"), "user_id").alias("set_id"), F.col("event_id").alias("version"),
                        F.col("ts").alias("taken"))
    return state.retire(versions, 7).select("set_id", "version")


# Streams -------------------------------------------------------------------------

@query("usage_stream", f"WITH {_DAILY} SELECT * FROM daily")
def usage_stream(spark, sf):
    """The daily counters, kept by a streaming query over the events in shuffled order."""
    folder = scratch(spark, "usage-in")
    events = adapters.mapped(spark, sf, "usage_events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    out = scratch(spark, "usage-out")
    usage_streams.start_usage(stream, out, scratch(spark, "usage-cp")).awaitTermination()
    return usage_streams.usage_counters(spark, out)


@query("change_stream", f"""
    WITH {header_sql('line_messages')},
    child AS (SELECT DISTINCT user_id, thread_id, message_id FROM kept),
    named AS (SELECT DISTINCT user_id, thread_id FROM {{changes}} WHERE thread_id IS NOT NULL)
    SELECT h.user_id, h.thread_id, h.subject, h.date_first, h.date_last, h.n_messages, h.has_attachments
    FROM head h JOIN named USING (user_id, thread_id)
""")
def change_stream(spark, sf):
    """Change events drive a sync in two micro-batches; the table it leaves."""
    root, run = _sync(spark, sf)
    run(_feed(spark, sf))
    return sync.current(spark, root).select(*_SYNCED)


_SYNCED = [*KEY, "subject", "date_first", "date_last", "n_messages", "has_attachments"]


def _feed(spark, sf):
    return adapters.mapped(spark, sf, "changes").selectExpr(
        *[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in CHANGES.split(",")]
    )


def _sync(spark, sf):
    """An empty archive, and a function that reports changes and syncs them on one checkpoint."""
    folder, root, box, cursor = (scratch(spark, n) for n in ("changes", "archive", "mailbox", "cursor"))
    sync.store_mailbox(adapters.messages(spark, sf, "line_messages", spread=16 << 20), box)
    mailbox = sync.Mailbox(lambda s: s.read.parquet(box), excluded=tuple(EXCLUDED))

    def run(feed, checkpoint=cursor, files=4, index=False):
        if feed is not None:
            feed.repartition(files, "seq").write.mode("append").parquet(folder)
        sync.start_sync(
            spark, folder, root, checkpoint, mailbox, "2024-02-01", files_per_batch=2, index=index
        ).awaitTermination()

    return root, run


_NAMED_SQL = f"""
    {header_sql('line_messages')},
    named AS (
        SELECT user_id, thread_id, min(seq) AS first_seq FROM {{changes}} WHERE thread_id IS NOT NULL GROUP BY ALL)
"""


def _half_tags(spark, sf, root, k):
    """Tags for every thread that is stored, in two versions of which the later counts."""
    rows = sync.current(spark, root).select(*KEY)
    both = F.array(F.lit(0), F.lit(1))
    return rows.select(
        *KEY, F.explode(both).alias("seq"), F.lit(False).alias("truncated"),
    ).withColumn("tags", F.when(F.col("seq") == 1, F.array(F.lit(f"round {k}"))).otherwise(F.array(F.lit("stale"))))


@query("change_stream_tagged", f"""
    WITH {header_sql('line_messages')}
    SELECT h.user_id, h.thread_id, h.n_messages,
           CASE WHEN first_seq % 2 = 0 THEN 'round 1' ELSE '' END AS tags
    FROM head h JOIN (
        SELECT user_id, thread_id, min(seq % 2) AS first_seq FROM {{changes}} WHERE thread_id IS NOT NULL GROUP BY ALL
    ) USING (user_id, thread_id)
""")
def change_stream_tagged(spark, sf):
    """Sync half of the changes, tag what is there, sync the rest on the same checkpoint."""
    root, run = _sync(spark, sf)
    feed = _feed(spark, sf)
    run(feed.filter("seq % 2 = 0"), files=2)
    sync.append_tags(spark, root, _half_tags(spark, sf, root, 1))
    run(feed.filter("seq % 2 = 1"), files=2)
    return sync.current(spark, root).select(*KEY, "n_messages", F.array_join("ai_tags", "|").alias("tags"))


@query("index_sync", f"""
    WITH {_NAMED_SQL},
    text AS (
        SELECT user_id, thread_id, h.subject || ' synced' || CASE WHEN p.a IS NULL THEN '' ELSE ' ' || p.a END AS txt
        FROM head h JOIN named USING (user_id, thread_id) LEFT JOIN (
            SELECT user_id, thread_id, string_agg(DISTINCT a, ' ') AS a
            FROM (SELECT user_id, thread_id, unnest([from_addr, to_1, to_2]) AS a FROM kept)
            WHERE a <> '' GROUP BY ALL) p USING (user_id, thread_id))
    SELECT token, count(*) AS n_threads FROM (
        SELECT unnest(list_distinct({sql_tokens('txt')})) AS token FROM text) GROUP BY token
""")
def index_sync(spark, sf):
    """The token index that syncs and a tagger keep, after the last of them."""
    root, run = _sync(spark, sf)
    feed = _feed(spark, sf)
    run(feed.filter("seq % 2 = 0"), files=2, index=True)
    run(feed.filter("seq % 2 = 1"), files=2, index=True)
    tags = sync.current(spark, root).select(
        *KEY, F.array(F.lit("synced")).alias("tags"), F.lit(False).alias("truncated"))
    sync.append_tags(spark, root, tags, index=True)
    return sync.postings(spark, root, "terms").groupBy("token").agg(F.count("*").alias("n_threads"))


@query("clear_cursors", f"""
    WITH {_NAMED_SQL}
    SELECT h.user_id, h.thread_id, h.n_messages, true AS kept
    FROM head h JOIN named USING (user_id, thread_id)
""")
def clear_cursors(spark, sf):
    """A sync that starts over on a new checkpoint leaves the table as it was."""
    root, run = _sync(spark, sf)
    run(_feed(spark, sf))
    before = sync.current(spark, root).select(*KEY, F.col("n_messages").alias("n"), F.lit(True).alias("kept"))
    run(None, checkpoint=scratch(spark, "cursor"))
    return sync.current(spark, root).join(before, KEY, "full").select(
        *KEY, "n_messages", F.coalesce(F.col("kept") & (F.col("n") == F.col("n_messages")), F.lit(False)).alias("kept"))


_POISON_SQL = """
    poison AS (SELECT user_id, source_id, min(seq) AS held_at FROM {changes} WHERE seq % 61 = 2 GROUP BY ALL)
"""


def _pages_sync(spark, sf):
    """An empty archive, the delta pages of all sources, and a function that delivers pages and syncs them."""
    folder, root, box, cursor = (scratch(spark, n) for n in ("pages", "archive", "mailbox", "cursor"))
    sync.store_mailbox(adapters.messages(spark, sf, "line_messages", spread=16 << 20), box)
    mailbox = sync.Mailbox(lambda s: s.read.parquet(box), excluded=tuple(EXCLUDED))
    item = F.to_json(F.struct(F.array(F.struct(
        F.coalesce("removed_message_id", F.concat(F.lit("m"), "seq")).alias("id"),
        F.col("thread_id").alias("conversationId"),
        F.when(F.col("removed_message_id").isNotNull(), F.struct(F.lit("deleted").alias("reason"))).alias("@removed"),
    )).alias("value")))
    pages = _feed(spark, sf).select("user_id", "source_id", item.alias("payload"), "seq")

    def run(delivered):
        delivered.write.mode("append").parquet(folder)
        feeds.start_feed_sync(spark, folder, root, cursor, mailbox, "2024-02-01").awaitTermination()

    return root, pages, run


def _poisoned(pages):
    """The pages with some cut short: every source that has such a page is held at its first one."""
    return pages.withColumn("payload", F.when(F.col("seq") % 61 == 2, F.substring("payload", 1, 12)).otherwise(
        F.col("payload")))


@query("cursor_commit", f"""
    WITH {_POISON_SQL}
    SELECT c.user_id, c.source_id, max(CASE WHEN held_at IS NULL OR seq < held_at THEN seq END) AS position,
           max(held_at) AS held_at, max(seq) AS later_position, CAST(NULL AS BIGINT) AS later_held_at
    FROM {{changes}} c LEFT JOIN poison USING (user_id, source_id) GROUP BY ALL
""")
def cursor_commit(spark, sf):
    """Positions of all sources after two deliveries with bad pages, and after held sources are asked again."""
    root, pages, run = _pages_sync(spark, sf)
    bad = _poisoned(pages)
    half = pages.agg(F.max("seq")).first()[0] // 2
    run(bad.filter(F.col("seq") <= half))
    run(bad.filter(F.col("seq") > half))
    before = materialise(feeds.positions(spark, root), "before")
    run(pages.join(feeds.ask_again(spark, root), feeds.SOURCE).filter("seq >= held_at").drop("held_at"))
    after = feeds.positions(spark, root).select(
        *feeds.SOURCE, F.col("position").alias("later_position"), F.col("held_at").alias("later_held_at"))
    return before.join(after, feeds.SOURCE)


@query("held_sources", f"""
    WITH {header_sql('line_messages')}, {_POISON_SQL},
    named AS (
        SELECT DISTINCT c.user_id, c.thread_id FROM {{changes}} c LEFT JOIN poison USING (user_id, source_id)
        WHERE thread_id IS NOT NULL AND (held_at IS NULL OR seq < held_at))
    SELECT h.user_id, h.thread_id, h.subject, h.date_first, h.date_last, h.n_messages, h.has_attachments
    FROM head h JOIN named USING (user_id, thread_id)
""")
def held_sources(spark, sf):
    """The threads of a delivery with bad pages: what lies behind one is not stored, all else is."""
    root, pages, run = _pages_sync(spark, sf)
    run(_poisoned(pages))
    return sync.current(spark, root).select(*_SYNCED)
