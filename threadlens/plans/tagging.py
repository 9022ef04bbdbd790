"""Queries over tags, tag requests and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import tags as tg, text as tx
from threadlens.operators import batches, tagging, threads as th
from threadlens.plans.common import (
    CHAT_SQL, chat_threads, kept_messages, sql_tokens,
)
from threadlens.plans.mail import body_sql
from threadlens.plans.registry import query
from threadlens.schemas import KEY
from threadlens.session import scratch
from threadlens.sources import adapters



def _noisy_tags():
    """Whitespace-separated words with blanks, tabs and mixed case around them."""
    return F.transform(F.split("text", " "), lambda w: F.concat(F.lit("  "), w, F.lit("\t")))


_CLEAN_SQL = """list_filter(list_transform(string_split(text, ' '),
    lambda w: regexp_replace(lower(w), '^[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+|[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+$', '', 'g')),
    lambda w: w <> '')"""
# DuckDB's list_distinct has no order; keep a word only at its first place.
_CLEAN_ORDERED = f"""
    SELECT doc_id, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:60], '|') AS tags
    FROM (SELECT doc_id, {_CLEAN_SQL} AS ws FROM documents)
"""


@query("clean_tags", _CLEAN_ORDERED)
def clean_tags(spark, sf):
    d = adapters.table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(tg.clean_tags(_noisy_tags()), "|").alias("tags"))


_TAGGED_DOCS = f"""
    lists AS (SELECT doc_id, string_split(text, ' ') AS old, {_CLEAN_SQL} AS ws FROM documents),
    cleaned AS (
        SELECT doc_id, old, list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:60] AS new FROM lists)
"""


def _docs_as_tags(spark, sf):
    d = adapters.table(spark, sf, "documents")
    return d.select(
        F.lit("u").alias("user_id"), F.concat(F.lit("d"), "doc_id").alias("thread_id"),
        F.split("text", " ").alias("ai_tags"), F.array(F.lit("kept"), "lang").alias("user_tags"), "doc_id",
    )


@query("tag_cleanup_stats", f"""
    WITH {_TAGGED_DOCS}
    SELECT count(*) AS scanned, count(nullif(old <> new, false)) AS changed,
           CAST(sum(CASE WHEN old <> new THEN len(old) - len(new) ELSE 0 END) AS BIGINT) AS removed
    FROM cleaned
""")
def tag_cleanup_stats(spark, sf):
    return tagging.cleanup_stats(_docs_as_tags(spark, sf))


@query("cleanup_tags", f"""
    WITH {_TAGGED_DOCS}
    SELECT doc_id, array_to_string(new, '|') AS tags, old <> new AS changed FROM cleaned
""")
def cleanup_tags(spark, sf):
    done = tagging.cleanup(_docs_as_tags(spark, sf))
    return done.select("doc_id", F.array_join("ai_tags", "|").alias("tags"),
                       F.col("ai_tags_changed").alias("changed"))


def _replies(spark, sf):
    """Replies of three lists per document, some fenced, cut off or short."""
    d = adapters.table(spark, sf, "documents")
    k = F.col("doc_id")
    words = F.array_distinct(tx.tokens(F.col("text")))
    whole = F.to_json(F.array(words, F.array(F.lit("Invoice "), F.lit(" invoice"), "lang"),
                              F.array(F.col("source"))))
    reply = (
        F.when(k % 5 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(k % 5 == 2, F.concat(F.substring_index(whole, "],[", 2), F.lit('],["cut of')))
        .when(k % 5 == 3, F.concat(F.lit("["), F.to_json(words), F.lit("]")))
        .when(k % 5 == 4, F.lit(None).cast("string"))
        .otherwise(whole)
    )
    return d.select("doc_id", reply.alias("reply"), "lang", "source")


_REPLY_SQL = f"""
    r AS (SELECT doc_id, doc_id % 5 AS k, lang, source, {sql_tokens('text')} AS toks FROM documents),
    f AS (SELECT *, list_filter(toks, lambda w, i: list_position(toks, w) = i)[1:60] AS firsts FROM r),
    p AS (
        SELECT doc_id, unnest([0, 1, 2]) AS pos,
               unnest([CASE WHEN k = 4 THEN [] ELSE firsts END,
                       CASE WHEN k IN (3, 4) THEN [] ELSE ['invoice', lang] END,
                       CASE WHEN k IN (2, 3, 4) THEN [] ELSE [source] END]) AS tags, k
        FROM f)
"""


@query("parse_tags", f"""
    WITH {_REPLY_SQL}
    SELECT doc_id, pos, array_to_string(tags, '|') AS tags,
           CASE WHEN k IN (0, 1) THEN false ELSE len(tags) = 0 END AS truncated FROM p
""")
def parse_tags(spark, sf):
    r = _replies(spark, sf)
    parsed = tg.parse_tags(F.col("reply"), F.lit(3))
    return r.select("doc_id", F.posexplode(parsed).alias("pos", "e")).select(
        "doc_id", "pos", F.array_join("e.tags", "|").alias("tags"), "e.truncated"
    )


@query("salvage_tags", f"""
    WITH {_REPLY_SQL}
    SELECT doc_id, pos, array_to_string(tags, '|') AS tags FROM p
""")
def salvage_tags(spark, sf):
    r = _replies(spark, sf)
    saved = tg.salvage_tags(tg.unfence(F.coalesce("reply", F.lit(""))), F.lit(3))
    return r.select("doc_id", F.posexplode(saved).alias("pos", "t")).select(
        "doc_id", "pos", F.array_join("t", "|").alias("tags")
    )


# Groups and batches ----------------------------------------------------------------

def _doc_groups(spark, sf):
    threads, _ = adapters.doc_threads(spark, sf)
    return tagging.tag_groups(threads.select(*KEY, "doc_id", "ai_tags"))


@query("w_tag_groups", """
    SELECT user_id, group_id, count(*) AS n, count(*) AS positions, CAST(0 AS BIGINT) AS first_pos,
           count(*) - 1 AS last_pos
    FROM (SELECT user_id, 'g' || CAST((row_number() OVER (PARTITION BY user_id ORDER BY thread_id) - 1) // 10
                 AS VARCHAR) AS group_id FROM {doc_threads})
    GROUP BY ALL
""")
def w_tag_groups(spark, sf):
    """Groups of ten per user: all full but the last, places without gaps."""
    return _doc_groups(spark, sf).groupBy("user_id", "group_id").agg(
        F.count("*").alias("n"), F.count_distinct("pos").alias("positions"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
    )


@query("tag_route", """
    SELECT 'u' || CAST(doc_id % 17 AS VARCHAR) AS user_id, count(*) AS pending,
           CASE WHEN count(*) >= 50 THEN 'batch' ELSE 'direct' END AS route
    FROM documents GROUP BY ALL
""")
def tag_route(spark, sf):
    d = adapters.table(spark, sf, "documents")
    return tagging.route(d.select(F.concat(F.lit("u"), F.col("doc_id") % 17).alias("user_id")))


def _batches(spark, sf):
    """Documents in batches of groups of ten by number, and one reply per group."""
    d = adapters.table(spark, sf, "documents")
    k = F.col("doc_id")
    batches = d.select(
        F.lit("u").alias("user_id"), F.concat(F.lit("b"), F.floor(k / 100)).alias("batch_id"),
        F.concat(F.lit("g"), F.floor(k / 10) % 10).alias("group_id"), (k % 10).alias("pos"),
        F.concat(F.lit("d"), "doc_id").alias("thread_id"),
    )
    lists = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "tags"))), lambda x: x["tags"]
    )
    replies = (
        d.select((F.floor(k / 10)).alias("g"), (k % 10).alias("pos"), F.array("lang", "source").alias("tags"))
        .groupBy("g").agg(F.to_json(lists).alias("reply"))
        .select(
            F.concat(F.lit("b"), F.floor(F.col("g") / 10)).alias("batch_id"),
            F.when(F.col("g") % 13 == 12, "unknown group")
            .otherwise(F.concat(F.lit("g"), F.col("g") % 10)).alias("group_id"),
            F.when(F.col("g") % 7 == 3, "errored").otherwise("succeeded").alias("status"), "reply",
        )
    )
    return batches, replies


_BATCH_SQL = """
    d AS (SELECT *, doc_id // 10 AS g FROM documents),
    done AS (SELECT * FROM d WHERE g % 13 <> 12 AND g % 7 <> 3)
"""


@query("j_batch_results", f"""
    WITH {_BATCH_SQL}
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS thread_id, 'b' || CAST(g // 10 AS VARCHAR) AS batch_id,
           lang || '|' || source AS tags, false AS truncated FROM done
""")
def j_batch_results(spark, sf):
    return tagging.join_replies(*_batches(spark, sf)).select(
        "thread_id", "batch_id", F.array_join("tags", "|").alias("tags"), "truncated"
    )


@query("j_batch_remainder", f"""
    WITH {_BATCH_SQL}
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS thread_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM done)
""")
def j_batch_remainder(spark, sf):
    batches, replies = _batches(spark, sf)
    return tagging.remainder(batches, tagging.join_replies(batches, replies)).select("thread_id")


@query("diff_done", f"""
    WITH {_BATCH_SQL}
    SELECT 'b' || CAST(g // 10 AS VARCHAR) AS batch_id, count(*) AS pending FROM d
    WHERE doc_id NOT IN (SELECT doc_id FROM done) GROUP BY ALL
""")
def diff_done(spark, sf):
    batches, replies = _batches(spark, sf)
    left = tagging.remainder(batches, tagging.join_replies(batches, replies))
    return left.groupBy("batch_id").agg(F.count("*").alias("pending"))


@query("set_tags", f"""
    WITH {_BATCH_SQL}
    SELECT t.thread_id,
           CASE WHEN x.doc_id IS NOT NULL THEN x.lang || '|' || x.source
                WHEN t.is_tagged = 1 THEN t.lang || '|' || t.source ELSE '' END AS tags,
           CASE WHEN x.doc_id IS NOT NULL THEN false ELSE true END AS truncated
    FROM {{doc_threads}} t LEFT JOIN done x ON x.doc_id = t.doc_id
""")
def set_tags(spark, sf):
    threads, _ = adapters.doc_threads(spark, sf)
    threads = threads.withColumns({"user_id": F.lit("u"), "tags_truncated": F.lit(True)})
    tags = tagging.join_replies(*_batches(spark, sf))
    return tagging.set_tags(threads, tags).select(
        "thread_id", F.array_join("ai_tags", "|").alias("tags"), F.col("tags_truncated").alias("truncated")
    )


@query("f_untagged", """
    SELECT user_id, thread_id FROM {doc_threads} WHERE is_tagged = 0
""")
def f_untagged(spark, sf):
    threads, _ = adapters.doc_threads(spark, sf)
    return tagging.untagged(threads).select(*KEY)


# Requests --------------------------------------------------------------------------

@query("p_tag_input", f"""
    WITH {CHAT_SQL}, body AS ({body_sql('chat_messages')})
    SELECT user_id, thread_id, subject, date_first AS date, body_text, body_scan_status
    FROM chat JOIN body USING (user_id, thread_id)
""")
def p_tag_input(spark, sf):
    threads, _ = chat_threads(spark, sf)
    content = th.thread_content(kept_messages(spark, sf, "chat_messages"))
    return tagging.tag_inputs(threads, content)


def _chat_lines(spark, sf):
    threads, people = chat_threads(spark, sf)
    content = th.thread_content(kept_messages(spark, sf, "chat_messages"))
    groups = tagging.tag_groups(threads.select(*KEY))
    return tagging.request_lines(groups, tagging.tag_inputs(threads, content), people)


@query("build_request", f"""
    WITH {CHAT_SQL}, body AS ({body_sql('chat_messages')}),
    lens AS (
        SELECT c.user_id, c.thread_id,
               length('subject: ' || subject) + length('started: ' || date_first)
               + length('text: ' || body_text)
               + CASE WHEN body_scan_status = 'truncated' THEN length(' (first 5000 characters)') ELSE 0 END
               + 3 AS head_chars,
               (SELECT count(*) FROM unnest(string_split(participants_str, ', '))) AS n_people,
               length(participants_str) AS p_chars
        FROM chat c JOIN body b USING (user_id, thread_id) JOIN people p USING (user_id, thread_id))
    SELECT user_id, count(*) AS n_threads, CAST(sum(4 + n_people) AS BIGINT) AS n_lines,
           CAST(sum(length('# thread 0') + head_chars + 1
                    + p_chars - 2 * (n_people - 1) + n_people * (length('person: ') + 1)) AS BIGINT) AS chars,
           CAST(ceil(count(*) / 10.0) AS BIGINT) AS n_groups
    FROM lens GROUP BY user_id
""")
def build_request(spark, sf):
    """Size of every user's request texts; one text per group of ten threads."""
    r = tagging.build_requests(_chat_lines(spark, sf))
    whole = F.length("request") + 1 == F.col("chars")
    return r.withColumn("n_threads", F.when(whole, F.col("n_threads"))).groupBy("user_id").agg(
        F.sum("n_threads").alias("n_threads"), F.sum("n_lines").alias("n_lines"),
        F.sum("chars").alias("chars"), F.count("*").alias("n_groups"),
    )


@query("retag_empty", f"""
    WITH {CHAT_SQL}, body AS ({body_sql('chat_messages')}),
    place AS (SELECT user_id, thread_id FROM chat WHERE len(ai_tags) = 0),
    lines AS (
        SELECT user_id, thread_id, 'subject: ' || subject || ' started: ' || date_first || ' text'
               || CASE WHEN body_scan_status = 'truncated' THEN ' (first 5000 characters)' ELSE '' END
               || ': ' || body_text || ' thread ' AS txt
        FROM place JOIN chat USING (user_id, thread_id) JOIN body USING (user_id, thread_id)
        UNION ALL
        SELECT user_id, thread_id, unnest(list_transform(string_split(participants_str, ', '),
               lambda p: 'person: ' || p)) FROM place JOIN people USING (user_id, thread_id)),
    counted AS (
        SELECT user_id, thread_id, token, count(*) AS n FROM (
            SELECT user_id, thread_id, unnest({sql_tokens('txt')}) AS token FROM lines)
        WHERE length(token) >= 4 GROUP BY ALL),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, thread_id ORDER BY n DESC, token) AS r FROM counted)
    SELECT user_id, thread_id, string_agg(token, '|' ORDER BY r) AS tags, false AS truncated
    FROM ranked WHERE r <= 12 GROUP BY user_id, thread_id
""")
def retag_empty(spark, sf):
    """All untagged threads through grouping, requests, the default tagger and parsing."""
    mail = kept_messages(spark, sf, "chat_messages")
    threads, people = chat_threads(spark, sf)
    return tagging.retag(threads, mail, people, th.thread_content).select(
        *KEY, F.array_join("tags", "|").alias("tags"), "truncated"
    )


@query("edit_user_tags", """
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS thread_id,
           CASE doc_id % 4 WHEN 0 THEN 'kept|' || lang WHEN 1 THEN lang || '|new tag'
                WHEN 2 THEN 'kept|' || lang ELSE 'kept|' || lang || '|' || repeat('x', 60) END AS tags,
           doc_id % 4 IN (1, 3) AS reviewed
    FROM documents
""")
def edit_user_tags(spark, sf):
    """No edit, an edit, one with too many tags, one with a very long tag."""
    threads = _docs_as_tags(spark, sf).withColumn("manually_reviewed", F.lit(False))
    k = F.col("doc_id")
    none = F.array().cast("array<string>")
    edits = threads.filter(k % 4 != 0).select(
        *KEY,
        F.when(k % 4 == 1, F.array(F.lit("  New Tag "), F.lit("new tag"), F.lit(" "), F.col("user_tags")[1]))
        .when(k % 4 == 2, F.array_repeat(F.lit("many"), 21))
        .otherwise(F.array(F.repeat(F.lit("X"), F.lit(70)))).alias("add"),
        F.when(k % 4 == 1, F.array(F.lit(" KEPT "))).otherwise(none).alias("remove"),
    )
    return tagging.edit_tags(threads, edits).select(
        "thread_id", F.array_join("user_tags", "|").alias("tags"),
        F.col("manually_reviewed").alias("reviewed"),
    )


@query("edit_user_tags_many", """
    WITH e AS (
        SELECT CASE WHEN l_linenumber <= 3 THEN 'd0' ELSE 'd' || CAST(l_orderkey % 50 AS VARCHAR) END AS thread_id,
               ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS seq, 't' || CAST(l_partkey % 50 AS VARCHAR) AS plus,
               't' || CAST(l_suppkey % 53 AS VARCHAR) AS minus FROM lineitem),
    gone AS (SELECT thread_id, minus AS tag, max(seq) AS last_seq FROM e GROUP BY ALL),
    since AS (
        SELECT thread_id, plus AS tag, min(seq) AS first_seq FROM e
        WHERE seq >= coalesce((SELECT last_seq FROM gone g WHERE g.thread_id = e.thread_id AND g.tag = e.plus), 0) GROUP BY ALL),
    docs AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS thread_id, lang FROM documents)
    SELECT thread_id, 'kept|' || lang || coalesce('|' || t.tags, '') AS tags,
           thread_id IN (SELECT thread_id FROM e) AS reviewed
    FROM docs LEFT JOIN (SELECT thread_id, string_agg(tag, '|' ORDER BY first_seq) AS tags FROM since GROUP BY ALL) t
    USING (thread_id)
""")
def edit_user_tags_many(spark, sf):
    """Every order line as an edit; nearly half of them edit one thread."""
    threads = _docs_as_tags(spark, sf).withColumn("manually_reviewed", F.lit(False))
    n = adapters.table(spark, sf, "lineitem")
    tag = lambda c, m: F.array(F.concat(F.lit("t"), (F.col(c) % m).cast("string")))
    edits = n.select(
        F.lit("u").alias("user_id"),
        F.when(F.col("l_linenumber") <= 3, "d0").otherwise(F.concat(F.lit("d"), F.col("l_orderkey") % 50)).alias("thread_id"),
        tag("l_partkey", 50).alias("add"), tag("l_suppkey", 53).alias("remove"),
        F.expr("((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey").alias("seq"),
    )
    return tagging.edit_tags(threads, edits).select(
        "thread_id", F.array_join("user_tags", "|").alias("tags"), F.col("manually_reviewed").alias("reviewed"))


@query("collect_batches", f"""
    WITH {_BATCH_SQL},
    b AS (
        SELECT DISTINCT g // 10 AS n, CASE (g // 10) % 4 WHEN 1 THEN 'in_progress' WHEN 2 THEN 'unknown' ELSE 'ended' END AS status,
               CASE WHEN (g // 10) % 8 = 2 THEN 'expired' WHEN (g // 10) % 4 IN (1, 2) THEN 'kept' ELSE 'collected' END AS state
        FROM d),
    tagged AS (SELECT g // 10 AS n, count(*) AS tags FROM done GROUP BY ALL),
    paid AS (
        SELECT g // 10 AS n, count(*) AS requests, sum(cost)::BIGINT AS input_tokens
        FROM (SELECT g, sum(length(text)) AS cost FROM d GROUP BY g) WHERE g % 7 <> 3 GROUP BY ALL),
    members AS (SELECT g // 10 AS n, count(*) AS m FROM d GROUP BY ALL)
    SELECT 'b' || CAST(b.n AS VARCHAR) AS batch_id, state,
           CASE WHEN state = 'collected' THEN coalesce(tags, 0) ELSE 0 END AS tags,
           CASE WHEN state = 'collected' THEN m - coalesce(tags, 0) ELSE 0 END AS untagged,
           CASE WHEN state = 'collected' THEN coalesce(requests, 0) ELSE 0 END AS requests,
           CASE WHEN state = 'collected' THEN coalesce(input_tokens, 0) ELSE 0 END AS input_tokens
    FROM b LEFT JOIN tagged USING (n) LEFT JOIN paid USING (n) LEFT JOIN members USING (n)
""")
def collect_batches(spark, sf):
    """Open batches collected, and collected again; tags and usage of each count once."""
    mapping, replies = _batches(spark, sf)
    d = adapters.table(spark, sf, "documents")
    g = F.floor(F.col("doc_id") / 10)
    cost = d.groupBy(F.concat(F.lit("b"), F.floor(g / 10)).alias("batch_id"), F.when(g % 13 == 12, "unknown group").otherwise(
        F.concat(F.lit("g"), g % 10)).alias("group_id"), g.alias("g")).agg(F.sum(F.length("text")).alias("input_tokens"))
    replies = replies.join(cost.drop("g"), ["batch_id", "group_id"]).withColumns({
        "output_tokens": F.lit(None).cast("bigint"), "cache_read_tokens": F.lit(0).cast("bigint")})
    n = F.substring("batch_id", 2, 20).cast("bigint")
    known = mapping.select("user_id", "batch_id").distinct().withColumns({
        "status": F.when(n % 4 == 1, "in_progress").when(n % 4 == 2, "unknown").otherwise("ended"),
        "submitted_at": F.when(n % 8 == 2, "2023-11-01T00:00:00").otherwise("2024-02-01T00:00:00")})
    root, now = scratch(spark, "batches"), F.lit("2024-02-10 00:00:00").cast("timestamp")
    first = batches.collect(known, mapping, replies, now, root)
    batches.collect(known, mapping, replies, now, root)
    count = lambda name, what: batches.read(spark, root, name).groupBy("batch_id").agg(*what)
    none = F.lit(0).cast("bigint")
    return (
        first.select("batch_id", "state")
        .join(count("tags", [F.count("*").alias("tags")]), "batch_id", "left")
        .join(count("left", [F.count("*").alias("untagged")]), "batch_id", "left")
        .join(count("usage", [F.sum("requests").alias("requests"), F.sum("input_tokens").alias("input_tokens")]), "batch_id", "left")
        .select("batch_id", "state", *[F.coalesce(c, none).alias(c) for c in ("tags", "untagged", "requests", "input_tokens")])
    )
