"""Queries over the token index and the multi-round search."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import tags as tg, text as tx
from threadlens.operators import index, rounds, search, substrings
from threadlens.plans.common import (
    CHAT_SQL, DOC_SQL, FILTER_SQL, MULTI_SQL, QUERY_SQL, SUBSTRING_SQL, WS_SQL, chat_threads, doc_index,
    doc_statistics, doc_substrings, multi_hits, saved_queries, sql_tokens, substring_queries,
)
from threadlens.plans.registry import query
from threadlens.schemas import KEY
from threadlens.sources import adapters


def typed(spark, rows: list[tuple]):
    """Queries typed by hand: (query_id, user_id, q, mode)."""
    return spark.createDataFrame(rows, "query_id bigint, user_id string, q string, search_mode string")


def doc_hits(spark, sf, rows):
    _, _, terms, positions = doc_index(spark, sf)
    return search.match(terms, positions, typed(spark, rows), doc_statistics(spark, sf)).select(
        F.col("query_id").cast("int").alias("query_id"), *KEY
    )


def has(word: str) -> str:
    return f"list_contains(toks, '{word}')"


def phrase(words: str) -> str:
    return f"contains(flat, ' {words} ')"


# The index ------------------------------------------------------------------------

@query("build_index", f"""
    WITH {DOC_SQL}
    SELECT token, count(DISTINCT (user_id, thread_id)) AS n_threads, count(*) AS n_places,
           CAST(sum(pos) AS BIGINT) AS pos_sum
    FROM (SELECT user_id, thread_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 - n_head AS pos
          FROM doc_tokens)
    GROUP BY token
""")
def build_index(spark, sf):
    """Vocabulary of the whole documents with thread, occurrence and place counts."""
    threads, people = adapters.doc_threads(spark, sf)
    terms, positions = index.terms(threads, people), index.positions(threads, people)
    places = positions.groupBy("token").agg(
        F.count("*").alias("n_places"), F.sum("pos").alias("pos_sum")
    )
    return terms.groupBy("token").agg(F.count("*").alias("n_threads")).join(places, "token")


@query("index_follow", f"""
    WITH dt AS (
        SELECT user_id, thread_id, is_tagged, lang, source, address_1, address_2,
               CASE WHEN doc_id % 3 = 1 THEN 'replaced subject ' || CAST(doc_id AS VARCHAR)
                    ELSE subject END AS subject
        FROM {{doc_threads}} WHERE doc_id % 5 <> 2),
    doc_text AS (
        SELECT user_id, thread_id,
               CASE WHEN is_tagged = 1 THEN lang || ' ' || source || ' ' ELSE '' END || subject
                   || ' ' || address_1 || ' ' || address_2 AS txt FROM dt)
    SELECT token, count(*) AS n_threads FROM (
        SELECT unnest(list_distinct({sql_tokens('txt')})) AS token FROM doc_text)
    GROUP BY token
""")
def index_follow(spark, sf):
    """The index after subjects changed, threads were added and threads deleted."""
    threads, people = adapters.doc_threads(spark, sf)
    k = F.col("doc_id")
    before = threads.filter(k % 7 != 0)
    indexed = index.terms(before, people.join(before.select(*KEY), KEY, "left_semi"))
    after = threads.filter(k % 5 != 2).withColumn(
        "subject",
        F.when(k % 3 == 1, F.concat(F.lit("replaced subject "), k)).otherwise(F.col("subject")),
    )
    changed = threads.filter((k % 3 == 1) | (k % 5 == 2) | (k % 7 == 0))
    left = people.join(after.select(*KEY), KEY, "left_semi")
    return index.refresh(indexed, after, left, changed).groupBy("token").agg(
        F.count("*").alias("n_threads")
    )


# Words and modes ------------------------------------------------------------------

@query("search_and", f"""
    WITH {DOC_SQL}
    SELECT 1 AS query_id, user_id, thread_id FROM doc_flat
        WHERE user_id = 'u0' AND {has('the')} AND {has('with')} AND {has('shanin')}
    UNION ALL SELECT 2, user_id, thread_id FROM doc_flat
        WHERE user_id = 'u1' AND {has('de')} AND {has('src4')}
    UNION ALL SELECT 3, user_id, thread_id FROM doc_flat
        WHERE user_id = 'u2' AND {has('the')} AND {has('nosuchtoken')}
""")
def search_and(spark, sf):
    return doc_hits(spark, sf, [
        (1, "u0", "the with\tShanin", "and"), (2, "u1", " DE src4 ", "and"),
        (3, "u2", "the nosuchtoken", "and"),
    ])


@query("search_or", f"""
    WITH {DOC_SQL}
    SELECT 1 AS query_id, user_id, thread_id FROM doc_flat
        WHERE user_id = 'u0' AND ({has('src4')} OR {has('shanin')} OR {has('nosuchtoken')})
    UNION ALL SELECT 2, user_id, thread_id FROM doc_flat WHERE user_id = 'u2' AND {has('und')}
""")
def search_or(spark, sf):
    return doc_hits(spark, sf, [(1, "u0", "src4 shanin nosuchtoken", "or"), (2, "u2", "und", "or")])


@query("search_nearly_all", f"""
    WITH {DOC_SQL}
    SELECT 1 AS query_id, user_id, thread_id FROM doc_flat
    WHERE user_id = 'u0' AND ({has('the')} OR {has('de')} OR {has('die')} OR {has('of')} OR {has('la')})
""")
def search_nearly_all(spark, sf):
    """Any of the commonest words: the widest search a tenant can type."""
    return doc_hits(spark, sf, [(1, "u0", "the de die of la", "or")])


@query("search_literal", f"""
    WITH {DOC_SQL}
    SELECT 1 AS query_id, user_id, thread_id FROM doc_flat
        WHERE user_id = 'u0' AND {has('and')} AND {has('or')}
    UNION ALL SELECT 2, user_id, thread_id FROM doc_flat WHERE user_id = 'u1' AND {has('near')}
    UNION ALL SELECT 3, user_id, thread_id FROM doc_flat
        WHERE user_id = 'u2' AND {has('the')} AND {has('of')}
""")
def search_literal(spark, sf):
    return doc_hits(spark, sf, [
        (1, "u0", "and or", "and"), (2, "u1", "NEAR", "and"), (3, "u2", '"the" (of)', "and"),
    ])


@query("search_phrase", f"""
    WITH {DOC_SQL}
    SELECT 1 AS query_id, user_id, thread_id FROM doc_flat
        WHERE user_id = 'u0' AND {phrase('of the')}
    UNION ALL SELECT 2, user_id, thread_id FROM doc_flat
        WHERE user_id = 'u1' AND {phrase('src4 archive example')} AND {has('the')}
    UNION ALL SELECT 3, user_id, thread_id FROM doc_flat
        WHERE user_id = 'u2' AND {phrase('example src5')}
    UNION ALL SELECT 4, user_id, thread_id FROM doc_flat
        WHERE user_id = 'u0' AND ({phrase('in the and')} OR {phrase('the the')} OR {has('shanin')})
    UNION ALL SELECT 5, user_id, thread_id FROM doc_flat
        WHERE user_id = 'u1' AND {phrase('en src1')}
""")
def search_phrase(spark, sf):
    """Adjacent tokens, also across addresses (3) and across tags (5)."""
    return doc_hits(spark, sf, [
        (1, "u0", "of-the", "and"), (2, "u1", "src4@archive.example the", "and"),
        (3, "u2", "example/src5", "and"), (4, "u0", "in-the-and the'the shanin", "or"),
        (5, "u1", "en_src1", "and"),
    ])


@query("search_empty_word", f"""
    WITH {DOC_SQL}
    SELECT 2 AS query_id, user_id, thread_id FROM doc_flat WHERE user_id = 'u0' AND {has('with')}
    UNION ALL SELECT 4, user_id, thread_id FROM doc_flat WHERE user_id = 'u1' AND {has('with')}
""")
def search_empty_word(spark, sf):
    return doc_hits(spark, sf, [
        (1, "u0", "* with", "and"), (2, "u0", "* with", "or"), (3, "u1", "***", "or"),
        (4, "u1", "with", "and"), (5, "u1", "   ", "and"),
    ])


@query("j_index_semi", f"""
    WITH {DOC_SQL} SELECT t.user_id, t.thread_id, t.date_last FROM dt t
    JOIN doc_flat d USING (user_id, thread_id) WHERE {has('with')}
""")
def j_index_semi(spark, sf):
    threads, _, terms, _ = doc_index(spark, sf)
    return threads.join(terms.filter("token = 'with'"), KEY, "left_semi").select(*KEY, "date_last")


_SUBSTRING_SQL = f"""
    base AS (SELECT * FROM {{saved_queries}}),
    qs AS ({SUBSTRING_SQL}),
    dt AS (
        SELECT user_id, thread_id, date_last, [
            translate(subject, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[]',
            CASE WHEN is_tagged = 1 THEN '["' || lang || '", "' || source || '"]' ELSE '[]' END,
            '"' || address_1 || '"', '"' || address_2 || '"'] AS texts
        FROM {{doc_threads}}),
    qw AS (
        SELECT query_id, user_id, search_mode, list_distinct(list_transform(
            list_filter(string_split_regex(q, '{WS_SQL}+'), lambda w: w <> ''),
            lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS ws
        FROM qs),
    held AS (
        SELECT query_id, d.user_id, d.thread_id, search_mode, len(ws) AS n,
               len(list_filter(ws, lambda w: len(list_filter(texts, lambda t: contains(t, w))) > 0)) AS hits
        FROM qw JOIN dt d USING (user_id)),
    found AS (
        SELECT query_id, user_id, thread_id FROM held
        WHERE n > 0 AND CASE search_mode WHEN 'or' THEN hits > 0 ELSE hits = n END)
"""


@query("search_substring", f"WITH {_SUBSTRING_SQL} SELECT query_id, user_id, thread_id FROM found")
def search_substring(spark, sf):
    """A table of substring searches of all tenants, through the index of character runs."""
    return substrings.match(doc_substrings(spark, sf), substring_queries(spark, sf))


@query("search_fallback", f"""
    WITH {_SUBSTRING_SQL},
    ranked AS (
        SELECT query_id, user_id, thread_id, count(*) OVER (PARTITION BY query_id) AS total,
               row_number() OVER (PARTITION BY query_id ORDER BY date_last DESC, thread_id) AS rank
        FROM found JOIN dt USING (user_id, thread_id))
    SELECT * FROM ranked WHERE rank <= 20
""")
def search_fallback(spark, sf):
    """Composed searches where there is no token index: substrings, page of 20, exact total."""
    threads, _ = adapters.doc_threads(spark, sf)
    queries = substring_queries(spark, sf).selectExpr(
        "*", "CAST(NULL AS BOOLEAN) AS has_attachments", "CAST(NULL AS BOOLEAN) AS has_multiple",
        "CAST(NULL AS STRING) AS date_from", "CAST(NULL AS STRING) AS date_to",
        "CAST(NULL AS BIGINT) AS min_attachment_kb", "'date_desc' AS sort_by")
    found = search.search_threads(threads, None, None, queries, 20, substrings=doc_substrings(spark, sf))
    return found.select("query_id", *KEY, "total", F.col("rank").cast("bigint").alias("rank"))


@query("term_statistics", f"""
    WITH {DOC_SQL}
    SELECT user_id, token, count(*) AS df FROM (
        SELECT user_id, thread_id, unnest(toks) AS token FROM doc_flat
        WHERE CAST(substring(thread_id, 2) AS BIGINT) % 5 <> 2) GROUP BY ALL
""")
def term_statistics(spark, sf):
    """Statistics kept by signed deltas: all threads come, then a fifth of them goes."""
    _, _, terms, _ = doc_index(spark, sf)
    gone = terms.filter(F.substring("thread_id", 2, 20).cast("bigint") % 5 == 2)
    nothing = terms.limit(0)
    log = index.deltas(nothing, terms).unionByName(index.deltas(gone, nothing))
    return index.summed(log)


@query("search_substring_typed", """
    SELECT user_id, thread_id FROM (
        SELECT user_id, thread_id, subject AS s, address_1 AS p1, address_2 AS p2,
               CASE WHEN is_tagged = 1 THEN '["' || lang || '", "' || source || '"]' ELSE '[]' END AS a
        FROM {doc_threads})
    WHERE (s ILIKE '%thsh%' OR a ILIKE '%thsh%' OR p1 ILIKE '%thsh%' OR p2 ILIKE '%thsh%')
      AND (contains(lower(s), '["en') OR contains(a, '["en'))
""")
def search_substring_typed(spark, sf):
    """One typed search by a scan, no index."""
    threads, people = adapters.doc_threads(spark, sf)
    return search.search_substring(threads, people, 'thSH ["en')


@query("search_precision", f"""
    WITH {DOC_SQL},
    w AS (SELECT unnest(['the', 'ion', 'src1', 'with']) AS word)
    SELECT word,
           count(nullif(contains(lower(t.subject), word)
               OR (t.is_tagged = 1 AND (contains('["' || t.lang || '", "' || t.source || '"]', word)))
               OR contains(t.address_1, word) OR contains(t.address_2, word), false)) AS by_substring,
           count(nullif(list_contains(d.toks, word), false)) AS by_token
    FROM w, dt t JOIN doc_flat d USING (user_id, thread_id) GROUP BY word
""")
def search_precision(spark, sf):
    threads, people, terms, _ = doc_index(spark, sf)
    return search.precision_report(threads, people, terms, ["the", "ion", "src1", "with"])


# Composed searches --------------------------------------------------------------------

_CHAT_FILTER = FILTER_SQL.replace("substring(t.date_last, 1, 10)", "t.day_max").replace(
    "substring(t.date_first, 1, 10)", "t.day_min"
)

_CHAT_QUERIES = """
    qs(query_id, user_id, word_1, word_2, mode, has_attachments, has_multiple, date_from, date_to,
       min_attachment_kb, sort_by) AS (VALUES
        (1, 'u1', 'chat', NULL, 'and', true, NULL, NULL, NULL, NULL, 'date_desc'),
        (2, 'u2', 'chat', 'user', 'and', NULL, true, '2024-03-01', '2024-10-01', NULL, 'date_asc'),
        (3, 'u3', 'bucket', 'starred', 'or', NULL, NULL, NULL, NULL, 40, 'nonsense'),
        (4, 'u4', NULL, NULL, 'and', NULL, NULL, '2024-06-01', NULL, NULL, 'last_synced'),
        (5, 'u0', 'desk1', 'system', 'and', false, NULL, NULL, '2024-09-09', NULL, 'date_desc'))
"""


@query("search_filtered", f"""
    WITH {CHAT_SQL}, {_CHAT_QUERIES},
    tok AS (SELECT user_id, thread_id, {sql_tokens('txt')} AS toks FROM chat_text),
    hits AS (
        SELECT q.query_id, t.*, q.sort_by FROM qs q JOIN chat t ON t.user_id = q.user_id
        JOIN tok ON tok.user_id = t.user_id AND tok.thread_id = t.thread_id
        WHERE (q.word_1 IS NULL
               OR (q.mode = 'and' AND list_contains(toks, q.word_1)
                   AND (q.word_2 IS NULL OR list_contains(toks, q.word_2)))
               OR (q.mode = 'or' AND (list_contains(toks, q.word_1) OR list_contains(toks, q.word_2))))
          AND {_CHAT_FILTER}),
    ranked AS (
        SELECT *, count(*) OVER (PARTITION BY query_id) AS total,
               row_number() OVER (PARTITION BY query_id ORDER BY
                   CASE sort_by WHEN 'date_asc' THEN date_first END ASC,
                   CASE sort_by WHEN 'date_desc' THEN date_last WHEN 'date_asc' THEN NULL
                        ELSE last_synced END DESC, thread_id) AS rank
        FROM hits)
    SELECT query_id, user_id, thread_id, subject, date_first, date_last, total, rank FROM ranked
    WHERE rank <= 5
""")
def search_filtered(spark, sf):
    """Words, filters, order, page of five and exact total, for five tenants at once."""
    from threadlens.schemas import QUERIES

    threads, people = chat_threads(spark, sf)
    rows = [
        ("u1", 1, 1, 1, "chat", "and", True, None, None, None, None, "date_desc"),
        ("u2", 1, 1, 2, "Chat  user", "and", None, True, "2024-10-01", "2024-03-01", None, "date_asc"),
        ("u3", 1, 1, 3, "bucket starred", "or", None, None, None, None, 40, "nonsense"),
        ("u4", 1, 1, 4, " ", "and", None, None, "2024-06-01", None, None, "last_synced"),
        ("u0", 1, 1, 5, "desk1 system", "and", False, None, None, "2024-09-09", None, "date_desc"),
    ]
    queries = spark.createDataFrame(rows, QUERIES)
    found = search.search_threads(
        threads, index.terms(threads, people), index.positions(threads, people), queries, limit=5
    )
    return found.select(F.col("query_id").cast("int").alias("query_id"), *KEY, "subject", "date_first",
                        "date_last", "total",
                        F.col("rank").cast("bigint").alias("rank"))


@query("f_date_swap", f"""
    WITH {DOC_SQL}, {QUERY_SQL}
    SELECT query_id, least(date_from, date_to) AS date_from, greatest(date_from, date_to) AS date_to
    FROM qs WHERE date_from IS NOT NULL AND date_to IS NOT NULL
    UNION ALL SELECT query_id, date_from, date_to FROM qs WHERE date_from IS NULL OR date_to IS NULL
""")
def f_date_swap(spark, sf):
    return search.swap_reversed(saved_queries(spark, sf)).select("query_id", "date_from", "date_to")


@query("search_total", f"""
    WITH {DOC_SQL}, {QUERY_SQL},
    hits AS (
        SELECT q.query_id, t.*, q.sort_by
        FROM (SELECT * FROM matched UNION ALL SELECT * FROM blank) m
        JOIN dt t USING (user_id, thread_id)
        JOIN (SELECT * REPLACE (
                  CASE WHEN date_from > date_to THEN date_to ELSE date_from END AS date_from,
                  CASE WHEN date_from > date_to THEN date_from ELSE date_to END AS date_to)
              FROM qs) q ON q.query_id = m.query_id
        WHERE {FILTER_SQL}),
    ranked AS (
        SELECT *, count(*) OVER (PARTITION BY query_id) AS total,
               row_number() OVER (PARTITION BY query_id ORDER BY
                   CASE sort_by WHEN 'date_asc' THEN date_first END ASC,
                   CASE sort_by WHEN 'date_asc' THEN NULL ELSE date_last END DESC, thread_id) AS rank
        FROM hits)
    SELECT query_id, thread_id, total, rank FROM ranked WHERE rank <= 200
""")
def search_total(spark, sf):
    """Every saved query over documents: a page of 200 and the exact total."""
    threads, _, terms, positions = doc_index(spark, sf)
    found = search.search_threads(
        threads, terms, positions, saved_queries(spark, sf), statistics=doc_statistics(spark, sf))
    return found.select("query_id", "thread_id", "total", F.col("rank").cast("bigint").alias("rank"))


@query("sort_modes", """
    SELECT thread_id, rank, mode FROM (
        SELECT thread_id, 'date_asc' AS mode,
               row_number() OVER (PARTITION BY user_id ORDER BY date_first, thread_id) AS rank
        FROM {order_threads}
        UNION ALL SELECT thread_id, 'date_desc',
               row_number() OVER (PARTITION BY user_id ORDER BY date_last DESC, thread_id)
        FROM {order_threads})
    WHERE rank <= 3
""")
def sort_modes(spark, sf):
    o = adapters.mapped(spark, sf, "order_threads").withColumnRenamed("user_id", "query_id")
    o = o.withColumn("last_synced", F.lit(""))
    both = o.withColumn("mode", F.explode(F.array(F.lit("date_asc"), F.lit("date_desc"))))
    ranked = search.pages_per_query(
        both.withColumn("query_id", F.concat_ws("/", "query_id", "mode")), 3, "mode"
    )
    return ranked.select("thread_id", F.col("rank").cast("bigint").alias("rank"), "mode")


@query("topk_page", """
    SELECT thread_id, date_last FROM {order_threads} ORDER BY date_last DESC, thread_id LIMIT 200
""")
def topk_page(spark, sf):
    o = adapters.mapped(spark, sf, "order_threads").withColumn("last_synced", F.col("date_first"))
    return search.page(o, "date_desc").select("thread_id", "date_last")


@query("p_result_card", f"""
    WITH {CHAT_SQL}
    SELECT thread_id, array_to_string(list_sort(ai_tags), '|') AS tags,
           array_to_string(list_sort(user_tags), '|') AS user_tags, participants_str,
           CASE WHEN k % 5 = 0 THEN 'https://mail.example/inbox' ELSE web_link END AS link
    FROM chat JOIN people USING (user_id, thread_id)
""")
def p_result_card(spark, sf):
    threads, people = chat_threads(spark, sf)
    number = F.regexp_extract("thread_id", r"\d+", 0).cast("bigint")
    hits = threads.withColumn("web_link", F.when(number % 5 == 0, "").otherwise(F.col("web_link")))
    return search.result_cards(hits, people).select(
        "thread_id", F.array_join("tags_sorted", "|").alias("tags"),
        F.array_join("user_tags_sorted", "|").alias("user_tags"), "participants_str", "link",
    )


@query("sort_tags", f"""
    SELECT doc_id, array_to_string(list_sort(list_distinct({sql_tokens('text')})), ' ') AS tags
    FROM documents
""")
def sort_tags(spark, sf):
    d = adapters.table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(F.array_sort(F.array_distinct(tx.tokens(F.col("text")))), " ")
                    .alias("tags"))


@query("p_search_preview", f"""
    WITH {CHAT_SQL}
    SELECT thread_id, subject, date_first, date_last, web_link, participants_str AS participants_preview,
           array_to_string(ai_tags, '|') AS tags_preview
    FROM chat JOIN people USING (user_id, thread_id)
""")
def p_search_preview(spark, sf):
    return search.previews(*chat_threads(spark, sf)).withColumn(
        "tags_preview", F.array_join("tags_preview", "|")
    )


@query("highlight_tags", f"""
    SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct({sql_tokens('text')}),
        lambda t: contains(t, 'ion') OR contains(t, 'ß') OR contains(t, 'wh'))), ' ') AS marked
    FROM documents
""")
def highlight_tags(spark, sf):
    d = adapters.table(spark, sf, "documents")
    marked = tg.highlighted(
        F.array_distinct(tx.tokens(F.col("text"))), F.array(F.lit("ION"), F.lit("ß"), F.lit("wh"))
    )
    return d.select("doc_id", F.array_join(F.array_sort(marked), " ").alias("marked"))


# Rounds --------------------------------------------------------------------------------

@query("multi_query", f"""
    WITH {MULTI_SQL} SELECT session_id, round, query_id, user_id, thread_id, date_last FROM multi
""")
def multi_query(spark, sf):
    hits, _, _ = multi_hits(spark, sf)
    return hits.select("session_id", "round", "query_id", *KEY, "date_last")


@query("merge_results", f"""
    WITH {MULTI_SQL} SELECT session_id, round, user_id, thread_id, query_id, date_last FROM merged
""")
def merge_results(spark, sf):
    hits, _, _ = multi_hits(spark, sf)
    return rounds.merge_round(hits)


@query("union_results", f"""
    WITH {MULTI_SQL} SELECT session_id, round, count(*) AS found FROM merged GROUP BY ALL
""")
def union_results(spark, sf):
    hits, _, _ = multi_hits(spark, sf)
    return rounds.merge_round(hits).groupBy("session_id", "round").agg(F.count("*").alias("found"))


@query("accumulate_rounds", f"""
    WITH {MULTI_SQL}
    SELECT session_id, user_id, thread_id, min(round) AS first_round FROM merged GROUP BY ALL
""")
def accumulate_rounds(spark, sf):
    hits, _, _ = multi_hits(spark, sf)
    return rounds.accumulate(rounds.merge_round(hits))


@query("new_in_round", f"""
    WITH {MULTI_SQL}
    SELECT session_id, round, user_id, thread_id, query_id FROM merged m WHERE round = 2
      AND NOT EXISTS (SELECT 1 FROM merged e WHERE e.round < 2 AND e.session_id = m.session_id
                      AND e.user_id = m.user_id AND e.thread_id = m.thread_id)
""")
def new_in_round(spark, sf):
    hits, _, _ = multi_hits(spark, sf)
    merged = rounds.merge_round(hits)
    return rounds.new_in_round(merged.filter("round = 2"), merged.filter("round < 2")).drop("date_last")


@query("round_summary", f"""
    WITH {MULTI_SQL},
    asked AS (SELECT session_id, round, count(*) AS asked, count(nullif(query_id % 11 = 4, false)) AS failed
              FROM qs GROUP BY ALL),
    found AS (SELECT m.session_id, m.round, count(*) AS found,
                     string_agg(t.subject || ' | ' || substring(t.date_first, 1, 10), chr(10)
                         ORDER BY m.query_id, m.date_last DESC, m.thread_id) AS listing
              FROM merged m JOIN dt t USING (user_id, thread_id) GROUP BY ALL)
    SELECT session_id, round, asked, failed, coalesce(found, 0) AS found,
           CASE WHEN found IS NULL THEN 'none' WHEN found >= 100 THEN 'count' ELSE 'list' END AS kind,
           CASE WHEN found < 100 THEN listing ELSE '' END AS listing
    FROM asked LEFT JOIN found USING (session_id, round)
""")
def round_summary(spark, sf):
    hits, threads, queries = multi_hits(spark, sf)
    asked = queries.withColumn("failed", F.col("query_id") % 11 == 4)
    return rounds.round_summary(rounds.merge_round(hits), asked, threads)


@query("show_top5", f"""
    WITH {MULTI_SQL}
    SELECT session_id, round, thread_id, place, greatest(found - 5, 0) AS more FROM (
        SELECT session_id, round, thread_id, count(*) OVER (PARTITION BY session_id, round) AS found,
               row_number() OVER (PARTITION BY session_id, round
                   ORDER BY query_id, date_last DESC, thread_id) AS place FROM merged)
    WHERE place <= 5
""")
def show_top5(spark, sf):
    hits, _, _ = multi_hits(spark, sf)
    return rounds.top_n(rounds.merge_round(hits)).select(
        "session_id", "round", "thread_id", F.col("place").cast("bigint").alias("place"), "more"
    )


_FOLD = """trim(regexp_replace(translate(lower({x}), '‘’‛“”–—', '''''''""--'), '\\s+', ' ', 'g'))"""


def sql_fold(x: str) -> str:
    return _FOLD.replace("{x}", x)


@query("fold_subject", f"""
    SELECT conv_id, turn, {sql_fold("'“' || role || '” — ' || text || '’s'")} AS folded FROM conversations
""")
def fold_subject(spark, sf):
    c = adapters.table(spark, sf, "conversations")
    raw = F.concat(F.lit("“"), "role", F.lit("” — "), "text", F.lit("’s"))
    return c.select("conv_id", "turn", tx.fold_subject(raw).alias("folded"))


@query("match_subjects", f"""
    WITH cited AS (
        SELECT CAST(item_id % 4 AS BIGINT) AS session_id, item_id AS cite_id, 'whole' AS way,
               '“' || text || '”' AS cited FROM benchmark
        UNION ALL SELECT CAST(item_id % 4 AS BIGINT), item_id + 1000000, 'part',
               string_split(text, '. ')[1] FROM benchmark
        UNION ALL SELECT CAST(item_id % 4 AS BIGINT), item_id + 2000000, 'none', 'Re: no' FROM benchmark),
    found AS (
        SELECT CAST(doc_id % 4 AS BIGINT) AS session_id, 'd' || CAST(doc_id AS VARCHAR) AS thread_id,
               text AS subject, doc_id AS found_pos FROM documents
        UNION ALL SELECT CAST(item_id % 4 AS BIGINT), 'b' || CAST(item_id AS VARCHAR),
               '“' || text || '”', 5000000 + item_id FROM benchmark),
    w AS (SELECT *, {sql_fold('cited')} AS w FROM cited),
    h AS (SELECT *, {sql_fold('subject')} AS h FROM found WHERE subject <> '')
    SELECT w.session_id, w.cite_id, w.cited, first(h.thread_id ORDER BY h.found_pos) AS thread_id
    FROM w LEFT JOIN h ON w.session_id = h.session_id
         AND (h = w OR (length(h) >= 12 AND length(h) < length(w) AND contains(w, h))
                    OR (length(w) >= 12 AND length(w) <= length(h) AND contains(h, w)))
    GROUP BY ALL
""")
def match_subjects(spark, sf):
    """Whole texts, their first sentences and a bare "Re: no", against all texts."""
    b = adapters.table(spark, sf, "benchmark")
    d = adapters.table(spark, sf, "documents")
    i, session = F.col("item_id"), (F.col("item_id") % 4).alias("session_id")
    cited = (
        b.select(session, i.alias("cite_id"), F.concat(F.lit("“"), "text", F.lit("”")).alias("cited"))
        .unionByName(b.select(session, (i + 1000000).alias("cite_id"),
                              F.substring_index("text", ". ", 1).alias("cited")))
        .unionByName(b.select(session, (i + 2000000).alias("cite_id"), F.lit("Re: no").alias("cited")))
    )
    found = d.select(
        (F.col("doc_id") % 4).alias("session_id"), F.concat(F.lit("d"), "doc_id").alias("thread_id"),
        F.col("text").alias("subject"), F.col("doc_id").alias("found_pos"),
    ).unionByName(b.select(
        session, F.concat(F.lit("b"), "item_id").alias("thread_id"),
        F.concat(F.lit("“"), "text", F.lit("”")).alias("subject"), (i + 5000000).alias("found_pos"),
    ))
    return rounds.match_subjects(cited, found)


@query("extract_citations", """
    SELECT page_id, cite_no, subject FROM (
        SELECT page_id, unnest([1, 2]) AS cite_no,
               unnest([trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), url]) AS subject
        FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> '')
    UNION ALL
    SELECT page_id, 1, url FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) = ''
""")
def extract_citations(spark, sf):
    p = adapters.table(spark, sf, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    text = F.concat(
        F.lit("It was found.\nTHREAD: "), title, F.lit(" \n THREAD: not at line start\nTHREAD:none\n"),
        F.lit("THREAD: "), F.col("url"),
    )
    shown = F.when(title == "", F.concat(F.lit("nothing\nTHREAD: "), F.col("url"))).otherwise(text)
    return p.select("page_id", F.posexplode(tx.citations(shown)).alias("i", "subject")).select(
        "page_id", (F.col("i") + 1).alias("cite_no"), "subject"
    )


@query("parse_agent_reply", """
    SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT)
           END AS k, CASE event_id % 4 WHEN 3 THEN 'Found it: ' || event_type END AS conclusion
    FROM events
""")
def parse_agent_reply(spark, sf):
    e = adapters.table(spark, sf, "events")
    reply = F.element_at(
        F.array(
            F.col("props"), F.concat(F.lit("```json\n"), "props", F.lit("\n```")),
            F.concat(F.lit("Here: "), "props", F.lit(" done.")),
            F.concat(F.lit("Found it: "), "event_type"),
        ),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    v = tg.parse_reply(reply)
    return e.select(
        "event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"),
        F.try_variant_get(v, "$.conclusion", "string").alias("conclusion"),
    )
