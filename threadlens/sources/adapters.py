"""Driver tables read as mail tables.

Each mapping is one SELECT that Spark and the checking engine both accept, so
the two sides of a comparison start from the same rows. Lists are spelled as
scalar columns there and put together in :func:`messages`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlens.session import parts_of, spread_if_small

MAPPINGS = {
    # messages of chat conversations
    "chat_messages": """
        SELECT 'u' || CAST(conv_id % 5 AS STRING) AS user_id,
               'c' || CAST(conv_id AS STRING) AS thread_id,
               'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS message_id,
               'Conversation ' || CAST(conv_id AS STRING) || ' from ' || role AS subject,
               role || '@mail.example' AS from_addr,
               'team' || CAST(conv_id % 3 AS STRING) || '@mail.example' AS to_1,
               CASE WHEN turn % 4 = 3 THEN ''
                    ELSE 'desk' || CAST(turn AS STRING) || '@mail.example' END AS to_2,
               CASE WHEN (conv_id + turn) % 11 = 0 THEN ''
                    ELSE '2024-' || lpad(CAST(conv_id % 12 + 1 AS STRING), 2, '0') || '-'
                         || lpad(CAST((turn * 3 + conv_id) % 28 + 1 AS STRING), 2, '0')
                         || 'T08:00:00Z' END AS date,
               (conv_id * 7 + turn) % 9 = 0 AS has_attachments,
               '<p>' || text || '</p><br/>' AS body,
               'https://mail.example/m/' || CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING)
                   AS web_link,
               CASE WHEN (conv_id + turn) % 10 = 0 THEN 'junkemail'
                    WHEN conv_id % 17 = 3 THEN 'drafts' ELSE 'inbox' END AS container_id,
               CAST(turn AS BIGINT) AS arrival_seq
        FROM {conversations}
    """,
    # order lines: many threads, repeated message ids
    "line_messages": """
        SELECT 'u' || CAST(l_orderkey % 97 AS STRING) AS user_id,
               'o' || CAST(l_orderkey AS STRING) AS thread_id,
               'o' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)
                   AS message_id,
               'Line ' || CAST(l_linenumber AS STRING) || ' for part '
                   || CAST(l_partkey AS STRING) AS subject,
               's' || CAST(l_suppkey AS STRING) || '@supplier.example' AS from_addr,
               'p' || CAST(l_partkey % 50 AS STRING) || '@parts.example' AS to_1,
               'desk@parts.example' AS to_2,
               substring(CAST(l_shipdate AS STRING), 1, 10) || 'T00:00:00Z' AS date,
               l_returnflag = 'R' AS has_attachments,
               '<b>' || l_returnflag || '</b> ' || l_linestatus || '  <i>part</i> '
                   || CAST(l_partkey AS STRING) AS body,
               'https://mail.example/o/' || CAST(l_orderkey AS STRING) AS web_link,
               CASE WHEN l_partkey % 10 = 0 THEN 'junkemail' ELSE 'inbox' END AS container_id,
               (CAST(l_partkey AS BIGINT) * 1000000 + CAST(l_suppkey AS BIGINT)) * 10000
                   + (CAST(substring(CAST(l_shipdate AS STRING), 1, 4) AS BIGINT) - 1990) * 372
                   + CAST(substring(CAST(l_shipdate AS STRING), 6, 2) AS BIGINT) * 31
                   + CAST(substring(CAST(l_shipdate AS STRING), 9, 2) AS BIGINT) AS arrival_seq
        FROM {lineitem}
    """,
    # one thread per document, the whole text searchable
    "doc_threads": """
        SELECT 'u' || CAST(doc_id % 3 AS STRING) AS user_id,
               'd' || CAST(doc_id AS STRING) AS thread_id,
               text AS subject,
               lang AS lang, source AS source,
               source || '@archive.example' AS address_1,
               lang || '-desk@archive.example' AS address_2,
               '20' || lpad(CAST(10 + doc_id % 14 AS STRING), 2, '0') || '-'
                   || lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0') || '-01T00:00:00Z' AS date_first,
               '20' || lpad(CAST(10 + doc_id % 14 AS STRING), 2, '0') || '-'
                   || lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0') || '-'
                   || lpad(CAST(doc_id % 27 + 1 AS STRING), 2, '0') || 'T00:00:00Z' AS date_last,
               CAST(doc_id % 4 + 1 AS BIGINT) AS n_messages,
               doc_id % 4 = 1 AS has_attachments,
               CASE WHEN doc_id % 5 = 4 THEN 0 ELSE 1 END AS is_tagged,
               CAST(n_chars AS BIGINT) AS max_attachment_size,
               doc_id AS doc_id
        FROM {documents}
    """,
    # attachments: a source is the thread, so threads are long; two tenants share message ids
    "doc_attachments": """
        SELECT 'u' || CAST(CAST(floor(doc_id / 10) AS BIGINT) % 2 AS STRING) AS user_id, source AS thread_id,
               source || '-' || CAST(doc_id % 10 AS STRING) AS message_id,
               'a' || CAST(doc_id AS STRING) AS attachment_id,
               'File ' || CAST(doc_id AS STRING)
                   || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.docx'
                      WHEN 3 THEN '.xlsx' ELSE '.Pdf' END AS name,
               CASE doc_id % 5 WHEN 0 THEN 'Application/PDF' WHEN 3 THEN 'application/vnd.ms-excel'
                    ELSE '' END AS content_type,
               CAST(n_chars AS BIGINT) AS size,
               CASE WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS extracted,
               doc_id AS doc_id
        FROM {documents}
    """,
    # one thread per order, two tenants per customer group
    "order_threads": """
        SELECT 'c' || CAST(o_custkey AS STRING) AS user_id,
               'o' || CAST(o_orderkey AS STRING) AS thread_id,
               'Order ' || CAST(o_orderkey AS STRING) || ' ' || o_orderpriority AS subject,
               substring(CAST(o_orderdate AS STRING), 1, 10) AS date_first,
               substring(CAST(o_orderdate AS STRING), 1, 8)
                   || lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0') AS date_last,
               CASE WHEN o_orderstatus = 'P' THEN '' ELSE lower(o_orderpriority) END AS tag_1,
               CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus AS o_orderstatus,
               CAST(round(o_totalprice) AS BIGINT) AS amount
        FROM {orders}
    """,
    "users": """
        SELECT 'c' || CAST(c_custkey AS STRING) AS user_id,
               c_name || '@Customer.example' AS email, c_name AS display_name,
               c_mktsegment AS segment
        FROM {customer}
    """,
    # tagger calls
    "usage_events": """
        SELECT 'c' || CAST(user_id AS STRING) AS user_id, ts AS ts,
               substring(CAST(ts AS STRING), 1, 10) AS day,
               event_type = 'purchase' AS batched,
               CAST(event_id % 1000 * 37 AS BIGINT) AS input_tokens,
               CAST(floor(value) AS BIGINT) * 11 AS output_tokens,
               CAST(event_id % 7 AS BIGINT) AS cache_read_tokens
        FROM {events}
    """,
    # key/value state written by running jobs
    "state_events": """
        SELECT 'c' || CAST(user_id AS STRING) AS user_id,
               CASE event_id % 4 WHEN 0 THEN 'progress_current' WHEN 1 THEN 'progress_total'
                    WHEN 2 THEN 'progress_status' ELSE 'progress_updated' END AS key,
               CASE event_id % 4
                    WHEN 0 THEN CAST(event_id % 90 AS STRING)
                    WHEN 1 THEN CAST(90 + event_id % 10 AS STRING)
                    WHEN 2 THEN CASE event_type WHEN 'view' THEN 'processing'
                                WHEN 'click' THEN 'tagging' WHEN 'error' THEN 'error'
                                WHEN 'signup' THEN 'updating threads' ELSE 'done' END
                    ELSE CAST(1704067200 + event_id * 259 AS STRING) END AS value,
               CAST(event_id AS BIGINT) AS seq
        FROM {events}
    """,
    # change feed over the order-line mailbox
    "changes": """
        SELECT 'u' || CAST((event_id * 3) % 97 AS STRING) AS user_id,
               event_type AS source_id,
               CASE WHEN event_type = 'error' THEN NULL
                    ELSE 'o' || CAST(event_id * 3 AS STRING) END AS thread_id,
               CASE WHEN event_type = 'error'
                    THEN 'o' || CAST(event_id * 3 AS STRING) || '-'
                         || CAST(event_id % 7 + 1 AS STRING) END AS removed_message_id,
               CAST(event_id AS BIGINT) AS seq
        FROM {events}
    """,
    # life of tag batches
    "batch_events": """
        SELECT 'c' || CAST(user_id AS STRING) AS user_id,
               'b' || CAST(event_id % 701 AS STRING) AS batch_id,
               CASE event_type WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'in_progress'
                    WHEN 'signup' THEN 'unknown' WHEN 'error' THEN 'unknown'
                    ELSE 'ended' END AS status,
               substring(CAST(ts AS STRING), 1, 19) AS submitted_at,
               CAST(event_id AS BIGINT) AS seq
        FROM {events}
    """,
    # saved searches: each benchmark text asked in three ways
    "saved_queries": """
        SELECT 'u' || CAST(item_id % 3 AS STRING) AS user_id,
               CAST(item_id % 4 AS BIGINT) AS session_id,
               CAST(1 + (item_id // 4) % 5 AS BIGINT) AS round,
               CAST(item_id AS BIGINT) AS item_id, text AS text
        FROM {benchmark}
    """,
}

_INPUTS = {
    "chat_messages": "conversations", "line_messages": "lineitem", "doc_threads": "documents",
    "doc_attachments": "documents", "order_threads": "orders", "users": "customer",
    "usage_events": "events", "state_events": "events", "changes": "events",
    "batch_events": "events", "saved_queries": "benchmark",
}


_SPREAD = {"documents": "doc_id", "pages": "page_id", "lineitem": "l_partkey"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool | int = True) -> DataFrame:
    """A driver table.

    ``spread`` is off where what follows deals its rows anyway, and a number where they
    are to lie in partitions of about so many stored bytes, however large the table.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not spread or name not in _SPREAD:
        return df
    return spread_if_small(df, _SPREAD[name]) if spread is True else df.repartition(parts_of(df, spread), _SPREAD[name])


def mapped(spark: SparkSession, sf_dir: str, name: str, spread: bool | int = True) -> DataFrame:
    """A driver table seen through one of the mappings above."""
    source = _INPUTS[name]
    text = MAPPINGS[name].replace("//", "DIV") if name == "saved_queries" else MAPPINGS[name]
    return spark.sql(text, **{source: table(spark, sf_dir, source, spread)})


def mapping_sql(name: str) -> str:
    """The same mapping as plain SQL over the registered table names."""
    return MAPPINGS[name].replace("{" + _INPUTS[name] + "}", _INPUTS[name]).strip()


def messages(spark: SparkSession, sf_dir: str, name: str, spread: bool | int = True) -> DataFrame:
    """``chat_messages`` or ``line_messages`` in the message shape."""
    raw = mapped(spark, sf_dir, name, spread)
    return raw.withColumn("to_addrs", F.array("to_1", "to_2")).drop("to_1", "to_2")


def doc_threads(spark: SparkSession, sf_dir: str, spread: bool = True) -> tuple[DataFrame, DataFrame]:
    """(threads, participants) over ``documents``."""
    raw = mapped(spark, sf_dir, "doc_threads", spread)
    threads = raw.select(
        "user_id", "thread_id", "subject", "date_first", "date_last", "n_messages",
        F.substring("date_first", 1, 10).alias("day_min"),
        F.substring("date_last", 1, 10).alias("day_max"),
        "has_attachments", "max_attachment_size",
        F.when(F.col("is_tagged") == 1, F.array("lang", "source"))
        .otherwise(F.array().cast("array<string>")).alias("ai_tags"),
        F.array().cast("array<string>").alias("user_tags"),
        F.concat(F.lit("https://mail.example/d/"), "doc_id").alias("web_link"),
        F.col("date_last").alias("last_synced"), "doc_id",
    )
    participants = raw.select(
        "user_id", "thread_id", F.explode(F.array("address_1", "address_2")).alias("address")
    )
    return threads, participants
