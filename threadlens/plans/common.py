"""Inputs that several queries share, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlens.operators import index, substrings, threads as th
from threadlens.session import parts_of, scratch
from threadlens.sources import adapters

EXCLUDED = ["junkemail", "drafts"]
WS_SQL = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def sql_tokens(text: str) -> str:
    return (
        f"list_filter(string_split_regex(strip_accents(lower({text})), "
        r"'[^\p{L}\p{N}\p{Co}]+'), lambda t: t <> '')"
    )


def sql_strip_html(text: str) -> str:
    no_markup = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({no_markup}, '{WS_SQL}+', ' ', 'g'))"


def kept_sql(mapping: str) -> str:
    """Messages outside excluded containers, first copy of each id."""
    return f"""
        SELECT * FROM {{{mapping}}} WHERE container_id NOT IN ('junkemail', 'drafts')
        QUALIFY row_number() OVER (
            PARTITION BY user_id, thread_id, message_id ORDER BY arrival_seq) = 1
    """


def header_sql(mapping: str) -> str:
    """CTEs ``kept`` and ``head``: thread headers of a message mapping."""
    return f"""
        kept AS ({kept_sql(mapping)}),
        head AS (
            SELECT user_id, thread_id,
                   first(subject ORDER BY date, arrival_seq, message_id) AS subject,
                   first(web_link ORDER BY date, arrival_seq, message_id) AS web_link,
                   min(date) AS date_first, max(date) AS date_last, count(*) AS n_messages,
                   min(substring(date, 1, 10)) AS day_min, max(substring(date, 1, 10)) AS day_max,
                   bool_or(has_attachments) AS has_attachments
            FROM kept GROUP BY user_id, thread_id)
    """


def kept_messages(spark: SparkSession, sf: str, mapping: str) -> DataFrame:
    return th.drop_containers(adapters.messages(spark, sf, mapping), EXCLUDED)


def chat_threads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(threads, participants) of the chat mailbox, with tags from the container rules."""
    mail = kept_messages(spark, sf, "chat_messages")
    number = F.regexp_extract("thread_id", r"\d+", 0).cast("bigint")
    threads = th.build_threads(mail).withColumns({
        "ai_tags": F.when(number % 4 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("chat"), F.concat(F.lit("bucket "), (number % 6).cast("string")))),
        "user_tags": F.when(number % 7 == 0, F.array(F.lit("starred")))
        .otherwise(F.array().cast("array<string>")),
        "max_attachment_size": number * 1000,
        "last_synced": F.concat(F.lit("2024-06-"), F.lpad((number % 28 + 1).cast("string"), 2, "0")),
    })
    return threads, th.participants(mail)


CHAT_SQL = header_sql("chat_messages") + """,
    num AS (SELECT *, CAST(regexp_extract(thread_id, '\\d+') AS BIGINT) AS k FROM head),
    chat AS (
        SELECT *, CASE WHEN k % 4 = 0 THEN [] ELSE ['chat', 'bucket ' || CAST(k % 6 AS VARCHAR)] END AS ai_tags,
               CASE WHEN k % 7 = 0 THEN ['starred'] ELSE [] END AS user_tags,
               k * 1000 AS max_attachment_size,
               '2024-06-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') AS last_synced
        FROM num),
    people AS (
        SELECT user_id, thread_id, string_agg(DISTINCT a, ', ' ORDER BY a) AS participants_str
        FROM (SELECT user_id, thread_id, unnest([from_addr, to_1, to_2]) AS a FROM kept)
        WHERE a <> '' GROUP BY 1, 2),
    chat_text AS (
        SELECT c.user_id, c.thread_id,
               array_to_string(c.ai_tags, ' ') || ' ' || array_to_string(c.user_tags, ' ') || ' '
                   || c.subject || ' ' || p.participants_str AS txt
        FROM chat c JOIN people p USING (user_id, thread_id))
"""

DOC_SQL = f"""
    dt AS (SELECT * FROM {{doc_threads}}),
    doc_text AS (
        SELECT user_id, thread_id,
               CASE WHEN is_tagged = 1 THEN lang || ' ' || source || ' ' ELSE '' END || subject AS head,
               least(address_1, address_2) || ' ' || greatest(address_1, address_2) AS people
        FROM dt),
    doc_tokens AS (
        SELECT user_id, thread_id, list_concat(h, p) AS toks, len(h) AS n_head FROM (
            SELECT user_id, thread_id, {sql_tokens('head')} AS h, {sql_tokens('people')} AS p
            FROM doc_text)),
    doc_flat AS (
        SELECT user_id, thread_id, list_distinct(toks) AS toks,
               ' ' || array_to_string(toks, ' ') || ' ' AS flat FROM doc_tokens)
"""


_STORED: dict[tuple[str, str], tuple[str, ...]] = {}


def doc_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(threads, participants, terms, positions) over whole documents.

    The index is a stored table, as a running archive has it: built once per
    application and input, then read by every search.
    """
    threads, people = adapters.doc_threads(spark, sf, spread=False)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        paths = (scratch(spark, "terms"), scratch(spark, "positions"), scratch(spark, "statistics"))
        parts = parts_of(adapters.table(spark, sf, "documents"))
        index.write(index.terms(threads, people, parts), paths[0])
        index.write(index.positions(threads, people, parts), paths[1])
        index.write_statistics(index.statistics(spark.read.parquet(paths[0])), paths[2])
        _STORED[key] = paths
    terms, positions = (spark.read.parquet(p) for p in _STORED[key][:2])
    return threads, people, terms, positions


def doc_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The term statistics stored beside :func:`doc_index`."""
    doc_index(spark, sf)
    return spark.read.parquet(_STORED[spark.sparkContext.applicationId, sf][2])


_SUBSTRINGS: dict[tuple[str, str], str] = {}


def doc_substrings(spark: SparkSession, sf: str) -> substrings.Index:
    """The substring index over whole documents, stored once per application and input."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SUBSTRINGS:
        path = scratch(spark, "substrings")
        parts = parts_of(adapters.table(spark, sf, "documents"))
        substrings.build(*adapters.doc_threads(spark, sf, spread=False), path, parts)
        _SUBSTRINGS[key] = path
    return substrings.read(spark, _SUBSTRINGS[key])


#: Pieces of a text as substring searches: (number, SQL of the typed words, mode).
PIECES = [
    (0, "substring(text, 3, 9)", "and"),
    (1, "upper(substring(text, 12, 4)) || ' ' || substring(text, 30, 2)", "or"),
    (2, "substring(text, 5, 1) || ' ' || substring(text, 20, 3) || chr(9) || substring(text, 40, 8)", "and"),
    (3, "'100%' || substring(text, 2, 1) || '_'", "and"),
    (4, "'[\"' || substring(text, 1, 1)", "or"),
    (5, "'SRC' || CAST(item_id % 7 AS STRING) || '@archive  en-desk'", "and"),
]


def substring_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Six substring searches per benchmark text: pieces of words, wildcard characters, tags, addresses."""
    base = adapters.mapped(spark, sf, "saved_queries")
    each = [base.selectExpr("user_id", f"item_id * {len(PIECES)} + {k} AS query_id", f"{q} AS q", f"'{mode}' AS search_mode")
            for k, q, mode in PIECES]
    return reduce(DataFrame.unionByName, each)


SUBSTRING_SQL = " UNION ALL ".join(
    f"SELECT user_id, item_id * {len(PIECES)} + {k} AS query_id, {q} AS q, '{mode}' AS search_mode FROM base"
    for k, q, mode in PIECES).replace("STRING", "VARCHAR")


def saved_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Three queries per benchmark text.

    0: any of its long words; 1: all its words; 2: all its sentences, each as
    one hyphenated phrase. Some carry filters.
    """
    base = adapters.mapped(spark, sf, "saved_queries")
    text = F.col("text")
    long_words = F.array_join(F.regexp_extract_all(text, F.lit("[a-zA-Z]{7,}"), F.lit(0)), " ")
    sentences = F.replace(text, F.lit(". "), F.lit("\n"))
    phrases = F.replace(F.replace(sentences, F.lit(" "), F.lit("-")), F.lit("\n"), F.lit(" "))
    ways = F.array(*[
        F.struct(F.lit(n).alias("way"), F.lit(mode).alias("search_mode"), q.alias("q"))
        for n, (mode, q) in enumerate((("or", long_words), ("and", text), ("and", phrases)))
    ])
    i = F.col("item_id")
    return base.select("*", F.explode(ways).alias("w")).select(
        "user_id", "session_id", "round", (i * 3 + F.col("w.way")).alias("query_id"), "w.q",
        "w.search_mode",
        F.when(i % 7 == 3, F.lit(True)).alias("has_attachments"),
        F.when(i % 6 == 1, F.lit(True)).alias("has_multiple"),
        F.when(i % 5 == 2, F.lit("2014-01-01")).alias("date_from"),
        F.when(i % 5 == 2, F.lit("2012-06-01")).when(i % 5 == 4, F.lit("2018-01-01")).alias("date_to"),
        F.when(i % 8 == 5, F.lit(2).cast("bigint")).alias("min_attachment_kb"),
        F.element_at(F.array(F.lit("date_asc"), F.lit("date_desc"), F.lit("other")),
                     (i % 3 + 1).cast("int")).alias("sort_by"),
    )


QUERY_SQL = f"""
    base AS (SELECT * FROM {{saved_queries}}),
    ways AS (
        SELECT *, 0 AS way, 'or' AS search_mode,
               array_to_string(regexp_extract_all(text, '[a-zA-Z]{{7,}}'), ' ') AS q FROM base
        UNION ALL SELECT *, 1, 'and', text FROM base
        UNION ALL SELECT *, 2, 'and',
               replace(replace(replace(text, '. ', chr(10)), ' ', '-'), chr(10), ' ') FROM base),
    qs AS (
        SELECT user_id, session_id, round, item_id * 3 + way AS query_id, q, search_mode,
               CASE WHEN item_id % 7 = 3 THEN true END AS has_attachments,
               CASE WHEN item_id % 6 = 1 THEN true END AS has_multiple,
               CASE WHEN item_id % 5 = 2 THEN '2014-01-01' END AS date_from,
               CASE WHEN item_id % 5 = 2 THEN '2012-06-01'
                    WHEN item_id % 5 = 4 THEN '2018-01-01' END AS date_to,
               CASE WHEN item_id % 8 = 5 THEN 2 END AS min_attachment_kb,
               ['date_asc', 'date_desc', 'other'][item_id % 3 + 1] AS sort_by
        FROM ways),
    qw AS (
        SELECT query_id, user_id, search_mode, w.word_no, {sql_tokens('w.word')} AS wt FROM (
            SELECT query_id, user_id, search_mode,
                   unnest(list_transform(list_filter(string_split_regex(q, '{WS_SQL}+'),
                       lambda x: x <> ''), lambda x, i: {{'word': x, 'word_no': i}})) AS w
            FROM qs)),
    qn AS (SELECT query_id, user_id, search_mode, count(*) AS n FROM qw GROUP BY ALL),
    hit_words AS (
        SELECT qw.query_id, d.user_id, d.thread_id, count(*) AS hits
        FROM qw JOIN doc_flat d ON d.user_id = qw.user_id
             AND len(wt) > 0
             AND CASE WHEN len(wt) = 1 THEN list_contains(d.toks, wt[1])
                      ELSE contains(d.flat, ' ' || array_to_string(wt, ' ') || ' ') END
        GROUP BY ALL),
    matched AS (
        SELECT h.query_id, h.user_id, h.thread_id FROM hit_words h JOIN qn USING (query_id)
        WHERE search_mode = 'or' OR hits = n),
    blank AS (
        SELECT q.query_id, d.user_id, d.thread_id FROM qs q JOIN doc_flat d USING (user_id)
        WHERE q.query_id NOT IN (SELECT query_id FROM qw))
"""

FILTER_SQL = """
        (q.has_attachments IS NULL OR t.has_attachments = q.has_attachments)
        AND (NOT coalesce(q.has_multiple, false) OR t.n_messages > 1)
        AND (q.date_from IS NULL OR substring(t.date_last, 1, 10) >= q.date_from)
        AND (q.date_to IS NULL OR substring(t.date_first, 1, 10) <= q.date_to)
        AND (q.min_attachment_kb IS NULL OR t.max_attachment_size >= q.min_attachment_kb * 1000)
"""

MULTI_SQL = f"""
    {DOC_SQL}, {QUERY_SQL},
    multi AS (
        SELECT q.session_id, q.round, q.query_id, t.user_id, t.thread_id, t.subject,
               t.date_first, t.date_last
        FROM matched m JOIN dt t USING (user_id, thread_id) JOIN qs q ON q.query_id = m.query_id
        WHERE {FILTER_SQL}),
    merged AS (
        SELECT session_id, round, user_id, thread_id, min(query_id) AS query_id,
               any_value(date_last) AS date_last
        FROM multi GROUP BY ALL)
"""


def multi_hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, threads, queries) of all saved queries over documents."""
    from threadlens.operators.search import multi_query

    threads, people, terms, positions = doc_index(spark, sf)
    queries = saved_queries(spark, sf)
    hits = multi_query(threads, terms, positions, queries, doc_statistics(spark, sf)).join(
        queries.select("query_id", "session_id", "round"), "query_id"
    )
    return hits, threads, queries
