"""Queries over messages, threads, bodies and attachments."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from threadlens.functions import text as tx, values
from threadlens.operators import attachments as att, search, threads as th
from threadlens.plans.common import (
    CHAT_SQL, EXCLUDED, chat_threads, header_sql, kept_messages, kept_sql, sql_strip_html, WS_SQL,
)
from threadlens.plans.registry import query
from threadlens.schemas import KEY
from threadlens.sources import adapters, changes, providers, store

HEADER_COLUMNS = [
    *KEY, "subject", "date_first", "date_last", "n_messages", "has_attachments", "web_link",
]


# Sources -----------------------------------------------------------------------

@query("scan_threads", f"""
    WITH {header_sql('chat_messages')}
    SELECT user_id, thread_id, subject, n_messages FROM head WHERE user_id = 'u1'
""")
def scan_threads(spark, sf):
    threads, _ = chat_threads(spark, sf)
    return threads.filter(F.col("user_id") == "u1").select(*KEY, "subject", "n_messages")


@query("normalise_graph", """
    SELECT user_id, message_id, thread_id,
           CASE WHEN turn % 5 = 1 THEN '' ELSE subject END AS subject, from_addr,
           CASE WHEN to_2 = '' THEN to_1 ELSE to_1 || ',' || to_2 END AS to_list,
           date, has_attachments, body, web_link, container_id, arrival_seq
    FROM (SELECT *, arrival_seq AS turn FROM {chat_messages})
""")
def normalise_graph(spark, sf):
    m = adapters.mapped(spark, sf, "chat_messages")
    blank = F.col("arrival_seq") % 3 == 0
    address = lambda c: F.struct(F.struct(F.col(c).alias("address")).alias("emailAddress"))
    payload = F.to_json(F.struct(
        F.col("message_id").alias("id"), F.col("thread_id").alias("conversationId"),
        F.when(F.col("arrival_seq") % 5 != 1, F.col("subject")).alias("subject"),
        F.struct(F.struct(F.col("from_addr").alias("address")).alias("emailAddress")).alias("from"),
        F.array(address("to_1"), address("to_2")).alias("toRecipients"),
        F.nullif("date", F.lit("")).alias("receivedDateTime"),
        F.col("has_attachments").alias("hasAttachments"),
        F.when(~blank, F.struct(F.col("body").alias("content"))).alias("body"),
        F.when(blank, F.col("body")).alias("bodyPreview"),
        F.col("web_link").alias("webLink"), F.col("container_id").alias("parentFolderId"),
    ))
    raw = m.select("user_id", payload.alias("payload"), "arrival_seq")
    return providers.normalise_graph(raw).withColumn(
        "to_list", F.array_join("to_addrs", ",")
    ).drop("to_addrs")


def _url64(col):
    """Unpadded base64url of a text, on one line."""
    out = F.base64(F.encode(col, "UTF-8"))
    for was, now in [("\r\n", ""), ("+", "-"), ("/", "_")]:
        out = F.replace(out, F.lit(was), F.lit(now))
    return F.rtrim(out, F.lit("="))


@query("normalise_gmail", """
    SELECT user_id, message_id, thread_id, subject, from_addr,
           CASE WHEN to_2 = '' THEN to_1 ELSE to_1 || ',' || to_2 END AS to_list,
           CASE WHEN arrival_seq % 6 = 5 THEN ''
                ELSE '2023-11-14T' || lpad(CAST(arrival_seq + 1 AS VARCHAR), 2, '0') || ':00:00+00:00'
           END AS date,
           has_attachments, body,
           'https://mail.google.com/mail/' || CASE WHEN user_id = 'u0' THEN 'u/0/#all/'
               ELSE '?authuser=' || user_id || '@mail.example#all/' END || message_id AS web_link,
           CASE WHEN container_id = 'junkemail' THEN 'SPAM' ELSE 'INBOX' END AS container_id,
           arrival_seq
    FROM {chat_messages}
""")
def normalise_gmail(spark, sf):
    m = adapters.mapped(spark, sf, "chat_messages")
    part = lambda mime, name, data, aid: F.concat(
        F.lit(f'{{"mimeType":"{mime}","filename":"{name}","body":{{"size":9'),
        F.coalesce(F.concat(F.lit(',"data":"'), data, F.lit('"')), F.lit("")),
        F.coalesce(F.concat(F.lit(',"attachmentId":"'), aid, F.lit('"')), F.lit("")), F.lit("}}"),
    )
    none = F.lit(None).cast("string")
    plain = part("text/plain", "", _url64(F.lit("plain only")), none)
    html = part("Text/HTML", "", _url64(F.col("body")), none)
    file = part("application/pdf", "scan.pdf", none, F.when(F.col("has_attachments"), "att-1"))
    pair = lambda name, value: F.concat(F.lit(f'{{"name":"{name}","value":"'), value, F.lit('"}'))
    to = F.when(F.col("to_2") == "", F.concat(F.lit("Team <"), "to_1", F.lit(">"))).otherwise(
        F.concat(F.lit('\\"Team, all\\" <'), "to_1", F.lit(">, "), "to_2")
    )
    text = F.concat(
        F.lit('{"mimeType":"multipart/mixed","headers":['), pair("SUBJECT", F.col("subject")), F.lit(","),
        pair("from", F.concat(F.lit("Sender <"), "from_addr", F.lit(">"))), F.lit(","), pair("To", to),
        F.lit('],"parts":[{"mimeType":"multipart/alternative","parts":['), plain, F.lit(","), html,
        F.lit("]},"), file, F.lit("]}"),
    )
    hour = (F.col("arrival_seq") + 1) * 3600000 + 1699920000000
    raw = m.select("user_id", "arrival_seq", F.concat(
        F.lit('{"id":"'), "message_id", F.lit('","threadId":"'), "thread_id",
        F.lit('","labelIds":["INBOX"'),
        F.when(F.col("container_id") == "junkemail", ',"SPAM"').otherwise(""),
        F.lit('],"internalDate":"'),
        F.when(F.col("arrival_seq") % 6 == 5, "bad").otherwise(hour.cast("string")),
        F.lit('","payload":'), text, F.lit("}"),
    ).alias("payload"))
    accounts = m.filter("user_id <> 'u0'").select("user_id").distinct().withColumn(
        "account", F.concat("user_id", F.lit("@mail.example"))
    )
    return providers.normalise_gmail(raw, accounts).withColumn(
        "to_list", F.array_join("to_addrs", ",")
    ).drop("to_addrs")


def _part_tree(spark, sf):
    """Documents as part trees: text parts, a nested pair, a file."""
    d = adapters.table(spark, sf, "documents")
    leaf = lambda mime, name, data: F.concat(
        F.lit(f'{{"mimeType":"{mime}","filename":"{name}","body":{{"data":"'), data,
        F.lit('","attachmentId":"'), F.lit("a1" if name else ""), F.lit('","size":'),
        F.col("n_chars").cast("string"), F.lit("}}"),
    )
    html = F.when(F.col("doc_id") % 3 != 0, F.concat(
        F.lit(","), leaf("TEXT/html", "", _url64(F.concat(F.lit("<p>"), "text", F.lit("</p>"))))
    )).otherwise("")
    payload = F.concat(
        F.lit('{"mimeType":"multipart/mixed","headers":[{"name":"sUBJECT","value":"Document '),
        F.col("doc_id").cast("string"),
        F.lit('"}],"parts":[{"mimeType":"multipart/alternative","parts":['),
        leaf("text/plain", "", _url64(F.col("text"))), html, F.lit("]},"),
        leaf("text/csv", "", _url64(F.lit("first,second"))), F.lit(","),
        leaf("application/pdf", "scan.pdf", F.lit("")), F.lit("]}"),
    )
    return d.select(F.lit("u").alias("user_id"), F.col("doc_id").cast("string").alias("message_id"),
                    payload.alias("payload"))


@query("mime_walk", """
    SELECT message_id, place, mime FROM (
        SELECT CAST(doc_id AS VARCHAR) AS message_id,
               unnest(list_transform(CASE WHEN doc_id % 3 = 0
                   THEN ['multipart/mixed', 'application/pdf', 'text/csv', 'multipart/alternative',
                         'text/plain']
                   ELSE ['multipart/mixed', 'application/pdf', 'text/csv', 'multipart/alternative',
                         'text/html', 'text/plain'] END,
                   lambda x, i: {'mime': x, 'place': i}), recursive := true)
        FROM documents)
""")
def mime_walk(spark, sf):
    parts = providers.mime_parts(_part_tree(spark, sf))
    place = F.row_number().over(Window.partitionBy("message_id").orderBy("visit"))
    return parts.select(
        "message_id", place.cast("bigint").alias("place"), F.lower("mimeType").alias("mime")
    )


@query("mime_body", """
    SELECT CAST(doc_id AS VARCHAR) AS message_id,
           CASE WHEN doc_id % 3 = 0 THEN 'first,second' ELSE '<p>' || text || '</p>' END AS body
    FROM documents
""")
def mime_body(spark, sf):
    return providers.mime_body(providers.mime_parts(_part_tree(spark, sf))).select("message_id", "body")


@query("mime_attachments", """
    SELECT CAST(doc_id AS VARCHAR) AS message_id, 'a1' AS attachment_id, 'scan.pdf' AS name,
           'application/pdf' AS content_type, CAST(n_chars AS BIGINT) AS size
    FROM documents
""")
def mime_attachments(spark, sf):
    return providers.mime_attachments(providers.mime_parts(_part_tree(spark, sf))).drop("user_id")


def _broken(payload):
    """Every eleventh payload cut short, every thirteenth missing, every seventeenth with fields of wrong types."""
    k = F.col("doc_id")
    wrong = F.replace(F.regexp_replace(payload, r'"size":\d+', '"size":"big"'), F.lit('"filename":"scan.pdf"'),
                      F.lit('"filename":"scan.pdf","headers":"none","parts":7'))
    return F.when(k % 11 == 3, F.substring("payload", 1, 20)).when(k % 13 == 5, F.lit(None)).when(
        k % 17 == 4, wrong).otherwise(payload)


@query("quarantine_mail", """
    SELECT CASE WHEN doc_id % 11 = 3 THEN 'malformed payload' WHEN doc_id % 13 = 5 THEN 'no payload'
                WHEN doc_id % 17 = 4 THEN 'unreadable: body.size, headers, parts' ELSE '' END AS error,
           count(*) AS messages, count(*) FILTER (error_free) AS bodies, coalesce(sum(chars) FILTER (error_free), 0)::BIGINT AS chars
    FROM (SELECT doc_id, NOT (doc_id % 11 = 3 OR doc_id % 13 = 5) AS error_free,
                 CASE WHEN doc_id % 3 = 0 THEN 12 ELSE length(text) + 7 END AS chars FROM documents)
    GROUP BY ALL
""")
def quarantine_mail(spark, sf):
    """Mail of which some is broken: what is put aside, and the bodies that are read all the same."""
    raw = _part_tree(spark, sf).withColumn("doc_id", F.col("message_id").cast("long")).withColumn(
        "payload", _broken(F.col("payload")))
    parts = providers.mime_parts(raw)
    aside = providers.quarantine_parts(raw, parts)
    # Lengths are joined, not texts.
    bodies = providers.mime_body(parts).select("user_id", "message_id", F.length("body").alias("chars"))
    return raw.select("user_id", "message_id").join(aside, ["user_id", "message_id"], "left").join(
        bodies, ["user_id", "message_id"], "left").groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(
        F.count("*").alias("messages"), F.count("chars").alias("bodies"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("chars"))


@query("quarantine_changes", """
    SELECT CASE WHEN seq % 7 = 2 THEN 'malformed payload' ELSE 'read' END AS error, count(*) AS n
    FROM {changes} GROUP BY ALL
""")
def quarantine_changes(spark, sf):
    """Delta pages of which some are broken: what is read, and the sources whose cursor must stay."""
    c = adapters.mapped(spark, sf, "changes")
    item = F.to_json(F.struct(F.array(F.struct(
        F.coalesce("removed_message_id", F.concat(F.lit("m"), "seq")).alias("id"),
        F.col("thread_id").alias("conversationId"),
        F.when(F.col("removed_message_id").isNotNull(), F.struct(F.lit("deleted").alias("reason"))).alias("@removed"),
    )).alias("value")))
    raw = c.select("user_id", "source_id", "seq", F.when(
        F.col("seq") % 7 == 2, F.concat(F.lit("{"), F.substring(item, 5, 30))).otherwise(item).alias("payload"))
    good = changes.delta_to_changes(raw).select(F.lit("read").alias("error"))
    bad = providers.quarantine(raw, changes.DELTA_PAGE, "user_id", "source_id", "seq").select("error")
    return good.unionByName(bad).groupBy("error").agg(F.count("*").alias("n"))


@query("header_value", """
    SELECT CAST(doc_id AS VARCHAR) AS message_id, 'Document ' || CAST(doc_id AS VARCHAR) AS subject,
           '' AS reply_to
    FROM documents
""")
def header_value(spark, sf):
    heads = F.from_json(
        "payload", "struct<headers: array<struct<name: string, value: string>>>"
    )["headers"]
    return _part_tree(spark, sf).select(
        "message_id", providers.header(heads, "Subject").alias("subject"),
        providers.header(heads, "Reply-To").alias("reply_to"),
    )


@query("normalise_attachments", """
    SELECT user_id, message_id, attachment_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE name END AS name,
           lower(content_type) AS content_type, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE size END AS size
    FROM {doc_attachments} WHERE doc_id % 6 <> 0
""")
def normalise_attachments(spark, sf):
    a = adapters.mapped(spark, sf, "doc_attachments")
    item = F.struct(
        F.when(F.col("doc_id") % 6 != 0, F.col("attachment_id")).alias("id"),
        F.when(F.col("doc_id") % 7 != 0, F.col("name")).alias("name"),
        F.col("content_type").alias("contentType"),
        F.when(F.col("doc_id") % 11 != 0, F.col("size")).alias("size"),
    )
    raw = a.select("user_id", "message_id", F.to_json(F.struct(F.array(item).alias("value"))).alias("payload"))
    return providers.normalise_attachments(raw)


@query("decode_content", """
    SELECT 'm' AS message_id, CAST(doc_id AS VARCHAR) AS attachment_id, text,
           CAST(strlen(text) AS BIGINT) AS n_bytes
    FROM documents WHERE doc_id % 9 <> 4
""")
def decode_content(spark, sf):
    d = adapters.table(spark, sf, "documents")
    plain = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    encoded = (
        F.when(F.col("doc_id") % 9 == 4, F.when(F.col("doc_id") % 2 == 0, "").otherwise("*not base64*"))
        .when(F.col("doc_id") % 2 == 0, F.rtrim(F.translate(plain, "+/", "-_"), F.lit("=")))
        .otherwise(plain)
    )
    raw = d.select(F.lit("u").alias("user_id"), F.lit("m").alias("message_id"), F.col("doc_id").cast("string").alias("attachment_id"),
                   encoded.alias("encoded"))
    return providers.decode_content(raw).select(
        "message_id", "attachment_id", F.decode("content", "UTF-8").alias("text"),
        F.octet_length("content").cast("bigint").alias("n_bytes"),
    )


@query("read_changes", """
    SELECT user_id, source_id, thread_id, removed_message_id, seq FROM {changes}
""")
def read_changes(spark, sf):
    c = adapters.mapped(spark, sf, "changes")
    item = F.to_json(F.struct(
        F.coalesce("removed_message_id", F.concat(F.lit("m"), "seq")).alias("id"),
        F.col("thread_id").alias("conversationId"),
        F.when(F.col("removed_message_id").isNotNull(), F.struct(F.lit("deleted").alias("reason")))
        .alias("@removed"),
    ))
    raw = c.select("user_id", "source_id", "seq",
                   F.concat(F.lit('{"value":['), item, F.lit("]}")).alias("payload"))
    return changes.delta_to_changes(raw)


@query("read_history", """
    SELECT user_id, 'mailbox' AS source_id, thread_id, removed_message_id, max(seq) AS seq FROM (
        SELECT 'u' || CAST(user_id AS VARCHAR) AS user_id,
               CASE WHEN event_type <> 'error' THEN 't' || CAST(event_id % 400 AS VARCHAR) END AS thread_id,
               CASE WHEN event_type = 'error' THEN 'm' || CAST(event_id AS VARCHAR) END
                   AS removed_message_id, event_id AS seq
        FROM events)
    GROUP BY ALL
""")
def read_history(spark, sf):
    e = adapters.table(spark, sf, "events")
    message = F.struct(F.struct(
        F.concat(F.lit("m"), "event_id").alias("id"),
        F.concat(F.lit("t"), F.col("event_id") % 400).alias("threadId"),
    ).alias("message"))
    kind = F.col("event_type")
    record = F.to_json(F.struct(F.array(F.struct(
        F.when(kind.isin("view", "click"), F.array(message)).alias("messagesAdded"),
        F.when(kind == "purchase", F.array(message)).alias("labelsAdded"),
        F.when(kind == "signup", F.array(message)).alias("labelsRemoved"),
        F.when(kind == "error", F.array(message)).alias("messagesDeleted"),
    )).alias("history")))
    raw = e.select(F.concat(F.lit("u"), "user_id").alias("user_id"), record.alias("payload"),
                   F.col("event_id").alias("seq"))
    return changes.history_to_changes(raw)


@query("full_resync", """
    SELECT user_id, 'mailbox' AS source_id, thread_id, max(arrival_seq) AS seq, true AS did_full_resync
    FROM {chat_messages} WHERE container_id <> 'junkemail' GROUP BY ALL
""")
def full_resync(spark, sf):
    m = adapters.messages(spark, sf, "chat_messages")
    return changes.full_changes(m, F.col("container_id") != "junkemail").drop("removed_message_id")


@query("folder_tree", """
    WITH RECURSIVE folders AS (
        SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS folder_id, NULL AS parent_id, r_name AS name FROM region
        UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), n_name FROM nation
        UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR), c_name FROM customer),
    open AS (SELECT * FROM folders WHERE folder_id NOT IN ('r1', 'n7', 'n12', 'c3')),
    walk AS (
        SELECT folder_id, name, 0 AS depth FROM open WHERE parent_id IS NULL
        UNION ALL
        SELECT o.folder_id, o.name, w.depth + 1 FROM walk w JOIN open o ON o.parent_id = w.folder_id)
    SELECT 'u' AS user_id, folder_id, name, depth FROM walk
""")
def folder_tree(spark, sf):
    t = lambda n: adapters.table(spark, sf, n)
    one = lambda df, p, key, up, parent, name: df.select(
        F.lit("u").alias("user_id"), F.concat(F.lit(p), key).alias("folder_id"),
        (F.concat(F.lit(up), parent) if up else F.lit(None).cast("string")).alias("parent_id"),
        F.col(name).alias("name"),
    )
    folders = (
        one(t("region"), "r", "r_regionkey", "", "", "r_name")
        .unionByName(one(t("nation"), "n", "n_nationkey", "r", "n_regionkey", "n_name"))
        .unionByName(one(t("customer"), "c", "c_custkey", "n", "c_nationkey", "c_name"))
    )
    excluded = folders.filter(F.col("folder_id").isin("r1", "n7", "n12", "c3"))
    return changes.folder_tree(folders, excluded)


# Threads ---------------------------------------------------------------------

for _name in ("chat", "line"):
    @query("build_threads" if _name == "line" else "build_threads_chat", f"""
        WITH {header_sql(_name + '_messages')}
        SELECT user_id, thread_id, subject, date_first, date_last, n_messages, has_attachments, web_link
        FROM head
    """)
    def build_threads(spark, sf, mapping=_name + "_messages"):
        return th.build_threads(kept_messages(spark, sf, mapping)).select(*HEADER_COLUMNS)

    @query("participants" if _name == "line" else "participants_chat", f"""
        WITH kept AS ({kept_sql(_name + '_messages')})
        SELECT DISTINCT user_id, thread_id, address FROM (
            SELECT user_id, thread_id, unnest([from_addr, to_1, to_2]) AS address FROM kept)
        WHERE address <> ''
    """)
    def participants(spark, sf, mapping=_name + "_messages"):
        return th.participants(kept_messages(spark, sf, mapping))


@query("w_dedupe_first", f"""
    WITH kept AS ({kept_sql('line_messages')})
    SELECT user_id, thread_id, message_id, date, substring(date, 1, 10) AS day, arrival_seq,
           has_attachments, web_link FROM kept
""")
def w_dedupe_first(spark, sf):
    return th.thread_messages(kept_messages(spark, sf, "line_messages"))


@query("w_first_last", f"""
    WITH kept AS ({kept_sql('line_messages')})
    SELECT user_id, thread_id, first(message_id ORDER BY date, arrival_seq, message_id) AS first_id,
           last(message_id ORDER BY date, arrival_seq, message_id) AS last_id
    FROM kept GROUP BY user_id, thread_id
""")
def w_first_last(spark, sf):
    return th.first_last(kept_messages(spark, sf, "line_messages"))


_BODY_SQL = """
    WITH kept AS ({kept}),
    b AS (SELECT *, {strip} AS t FROM kept),
    c AS (
        SELECT user_id, thread_id, sum(length(t)) AS body_char_count, bool_or(length(t) > 5000) AS cut,
               coalesce(string_agg(substring(t, 1, 5000), ' ' ORDER BY date, arrival_seq, message_id)
                   FILTER (t <> ''), '') AS whole
        FROM b GROUP BY user_id, thread_id)
    SELECT user_id, thread_id, substring(whole, 1, 5000) AS body_text,
           CAST(body_char_count AS BIGINT) AS body_char_count,
           CASE WHEN cut OR length(whole) > 5000 THEN 'truncated' ELSE 'ok' END AS body_scan_status
    FROM c
"""


def body_sql(mapping: str) -> str:
    return _BODY_SQL.replace("{kept}", kept_sql(mapping)).replace("{strip}", sql_strip_html("body"))


@query("thread_content", body_sql("chat_messages"))
def thread_content(spark, sf):
    return th.thread_content(kept_messages(spark, sf, "chat_messages"))


@query("j_thread_messages", body_sql("line_messages"))
def j_thread_messages(spark, sf):
    return th.thread_content(kept_messages(spark, sf, "line_messages"))


@query("f_container", """
    SELECT user_id, thread_id, message_id, container_id FROM {chat_messages}
    WHERE container_id NOT IN ('junkemail', 'drafts')
""")
def f_container(spark, sf):
    m = adapters.messages(spark, sf, "chat_messages")
    return th.drop_containers(m, EXCLUDED).select(*KEY, "message_id", "container_id")


@query("strip_html", f"""
    SELECT page_id, {sql_strip_html('html')} AS body FROM pages
""")
def strip_html(spark, sf):
    return adapters.table(spark, sf, "pages").select("page_id", tx.strip_html(F.col("html")).alias("body"))


@query("cap_text", f"""
    SELECT page_id, substring(b, 1, 5000) AS body, length(b) AS chars, length(b) > 5000 AS truncated
    FROM (SELECT page_id, {sql_strip_html('html')} AS b FROM pages)
""")
def cap_text(spark, sf):
    c = tx.message_text(F.col("html"))
    return adapters.table(spark, sf, "pages").select("page_id", c.alias("c")).select(
        "page_id", F.col("c.text").alias("body"), "c.chars", "c.truncated"
    )


@query("j_changed_threads", """
    WITH o AS (SELECT * FROM {order_threads}),
    cur AS (SELECT user_id, thread_id,
                   CASE WHEN o_orderkey % 5 = 0 THEN '9999-01-01'
                        WHEN o_orderkey % 5 = 1 THEN date_first ELSE date_last END AS date_last
            FROM o WHERE o_orderkey % 4 <> 3)
    SELECT o.user_id, o.thread_id, o.date_last FROM o LEFT JOIN cur USING (user_id, thread_id)
    WHERE cur.thread_id IS NULL OR o.o_orderkey % 10 = 0 OR o.date_last > cur.date_last
""")
def j_changed_threads(spark, sf):
    o = adapters.mapped(spark, sf, "order_threads")
    k = F.col("o_orderkey")
    current = o.filter(k % 4 != 3).withColumn(
        "date_last", F.when(k % 5 == 0, "9999-01-01").when(k % 5 == 1, F.col("date_first"))
        .otherwise(F.col("date_last"))
    )
    return th.changed_threads(current, o, o.filter(k % 10 == 0)).select(*KEY, "date_last")


_REMOVED_SQL = """
    child AS (SELECT DISTINCT user_id, thread_id, message_id FROM {line_messages}),
    traced AS (
        SELECT DISTINCT c.user_id, c.thread_id FROM child c
        JOIN {changes} e ON e.user_id = c.user_id AND e.removed_message_id = c.message_id)
"""


@query("j_removed_to_threads", f"WITH {_REMOVED_SQL} SELECT * FROM traced")
def j_removed_to_threads(spark, sf):
    child = th.thread_messages(adapters.messages(spark, sf, "line_messages"))
    removed = adapters.mapped(spark, sf, "changes").filter("removed_message_id is not null").select(
        "user_id", F.col("removed_message_id").alias("message_id")
    )
    return th.threads_of_messages(child, removed)


@query("union_changes", f"""
    WITH {_REMOVED_SQL}
    SELECT user_id, thread_id, bool_or(forced) AS forced FROM (
        SELECT user_id, thread_id, false AS forced FROM {{changes}} WHERE thread_id IS NOT NULL
        UNION ALL SELECT user_id, thread_id, true FROM traced)
    GROUP BY ALL
""")
def union_changes(spark, sf):
    child = th.thread_messages(adapters.messages(spark, sf, "line_messages"))
    return th.touched(adapters.mapped(spark, sf, "changes"), child)


@query("archive_composition", f"""
    WITH {header_sql('line_messages')}
    SELECT count(*) AS threads, count(nullif(has_attachments, false)) AS with_attachments,
           count(nullif(n_messages > 1, false)) AS with_replies FROM head
""")
def archive_composition(spark, sf):
    return th.composition(th.build_threads(kept_messages(spark, sf, "line_messages")))


@query("p_date_label", """
    SELECT thread_id, CASE WHEN date_first <> date_last THEN date_first || ' — ' || date_last
                           ELSE date_last END AS label FROM {order_threads}
""")
def p_date_label(spark, sf):
    o = adapters.mapped(spark, sf, "order_threads")
    return o.select("thread_id", tx.date_label(F.col("date_first"), F.col("date_last")).alias("label"))


@query("msg_day", """
    SELECT event_id, substring(CAST(ts AS VARCHAR), 1, 10) AS day,
           substring(CAST(ts AS VARCHAR), 1, 7) || '-01' AS month_start FROM events
""")
def msg_day(spark, sf):
    e = adapters.table(spark, sf, "events")
    return e.select(
        "event_id", values.message_day(F.col("ts").cast("string")).alias("day"),
        values.month_start(F.col("ts")).alias("month_start"),
    )


@query("safe_int", """
    SELECT event_id, CASE WHEN k > 0 THEN k END AS number FROM (
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT)
            WHEN 1 THEN -CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
        FROM events)
""")
def safe_int(spark, sf):
    e = adapters.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    raw = F.element_at(
        F.array(k, F.concat(F.lit("-"), k), F.lit(""), F.concat(k, F.lit("x"))),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    return e.select("event_id", values.positive_int(raw).alias("number"))


@query("json_each", """
    SELECT event_id, key, value FROM (
        SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS value
        FROM events)
""")
def json_each(spark, sf):
    e = adapters.table(spark, sf, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("json_len", """
    SELECT event_id, CAST(len(json_keys(props)) AS BIGINT) AS n,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""")
def json_len(spark, sf):
    e = adapters.table(spark, sf, "events")
    return e.select(
        "event_id", F.size(F.json_object_keys("props")).cast("bigint").alias("n"),
        F.from_json("props", "k bigint")["k"].alias("k"),
    )


# Attachments --------------------------------------------------------------------

def _attachments(spark, sf):
    a = adapters.mapped(spark, sf, "doc_attachments")
    child = a.select(*KEY, "message_id").distinct().withColumn(
        "has_attachments", F.substring("message_id", -1, 1) != "3"
    )
    meta = a.select("user_id", "message_id", "attachment_id", "name", "content_type", "size")
    return child, meta, a.select("user_id", "message_id", "attachment_id", F.col("extracted").alias("text"))


_ATTACH_SQL = """
    a AS (SELECT *, lower(name) LIKE '%.pdf' OR lower(name) LIKE '%.docx' AS readable
          FROM {doc_attachments}),
    att AS (
        SELECT user_id, thread_id, message_id, attachment_id, name, lower(content_type) AS content_type,
               size, CASE WHEN NOT readable THEN 'unsupported' WHEN coalesce(extracted, '') = '' THEN 'failed'
                          WHEN length(extracted) > 5000 THEN 'truncated' ELSE 'ok' END AS scan_status,
               extracted
        FROM a WHERE right(message_id, 1) <> '3')
"""


@query("scan_status", f"""
    WITH {_ATTACH_SQL}
    SELECT user_id, thread_id, message_id, attachment_id, name, content_type, size, scan_status,
           CASE WHEN scan_status IN ('ok', 'truncated') THEN length(extracted) ELSE 0 END
               AS actual_char_count,
           CASE WHEN scan_status IN ('ok', 'truncated') THEN substring(extracted, 1, 5000) ELSE '' END
               AS text
    FROM att
""")
def scan_status(spark, sf):
    return att.attach(*_attachments(spark, sf))


@query("j_message_attachments", f"""
    WITH {_ATTACH_SQL} SELECT user_id, message_id, attachment_id, name, scan_status FROM att
""")
def j_message_attachments(spark, sf):
    return att.attach(*_attachments(spark, sf)).select(
        "user_id", "message_id", "attachment_id", "name", "scan_status")


@query("j_attachment_content", f"""
    WITH {_ATTACH_SQL}
    SELECT user_id, scan_status, count(*) AS files,
           CAST(sum(CASE WHEN scan_status IN ('ok', 'truncated') THEN length(extracted) ELSE 0 END)
               AS BIGINT) AS chars
    FROM att GROUP BY ALL
""")
def j_attachment_content(spark, sf):
    return att.attach(*_attachments(spark, sf)).groupBy("user_id", "scan_status").agg(
        F.count("*").alias("files"), F.sum("actual_char_count").alias("chars")
    )


@query("p_storage_copy", f"""
    WITH {_ATTACH_SQL}
    SELECT user_id, thread_id, message_id, attachment_id, name, content_type, size, scan_status,
           CASE WHEN scan_status IN ('ok', 'truncated') THEN length(extracted) ELSE 0 END
               AS actual_char_count
    FROM att
""")
def p_storage_copy(spark, sf):
    return att.storage_columns(att.attach(*_attachments(spark, sf)))


@query("attachment_columns", f"""
    WITH {_ATTACH_SQL}
    SELECT user_id, thread_id, max(size) AS max_attachment_size,
           bool_or(scan_status IN ('failed', 'truncated')) AS attachments_incomplete
    FROM att GROUP BY ALL
""")
def attachment_columns(spark, sf):
    return att.per_thread(att.attach(*_attachments(spark, sf)))


@query("f_attachment_pairs", """
    SELECT user_id, message_id, attachment_id FROM {doc_attachments}
    WHERE right(message_id, 1) <> '3' AND (lower(name) LIKE '%.pdf' OR lower(name) LIKE '%.docx')
""")
def f_attachment_pairs(spark, sf):
    child, meta, _ = _attachments(spark, sf)
    return att.attachment_pairs(child, meta)


@query("extract_text", f"""
    SELECT doc_id, t AS text, length(t) AS chars FROM (
        SELECT doc_id, regexp_replace(substring(array_to_string(list_filter(
            string_split(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', '', 'g'), chr(10)),
            lambda x: NOT regexp_full_match(x, '{WS_SQL}*')), chr(10)), 1, 50000),
            '^{WS_SQL}+|{WS_SQL}+$', '', 'g') AS t
        FROM documents)
""")
def extract_text(spark, sf):
    """Minimal word-processor files made of the documents, read back in Python."""
    d = adapters.table(spark, sf, "documents")
    files = d.select(
        "doc_id", F.concat(F.lit("f"), "doc_id", F.lit(".docx")).alias("name"),
        F.lit("").alias("content_type"), F.encode("text", "UTF-8").alias("content"),
    )

    def pack(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        ns = att.WORD_NS.strip("{}")
        for b in batches:
            out = []
            for raw in b["content"]:
                lines = bytes(raw).decode("utf-8").split("\n")
                # XML has no control characters apart from tab and line ends.
                clean = ["".join(c for c in t if c >= " " or c == "\t") for t in lines]
                body = "".join(f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>" for t in clean)
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr("word/document.xml",
                               f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
                out.append(buffer.getvalue())
            yield b.assign(content=out)

    packed = files.mapInPandas(pack, files.schema)
    return att.extract_text(packed).select("doc_id", "text", F.length("text").cast("bigint").alias("chars"))


# Export, import, snapshots -----------------------------------------------------------

@query("export_threads", f"""
    WITH {CHAT_SQL}
    SELECT 'copy' AS user_id, thread_id, subject, date_first, date_last, n_messages,
           array_to_string(ai_tags, ',') AS tags FROM chat WHERE user_id = 'u2'
""")
def export_threads(spark, sf):
    """Write one tenant's threads, read them back as another tenant's."""
    from threadlens.session import scratch

    threads, _ = chat_threads(spark, sf)
    path = scratch(spark, "export")
    store.export_threads({"threads": threads.filter("user_id = 'u2'")}, path)
    back = store.read_export(spark, path, "copy")
    return back.select(*KEY, "subject", "date_first", "date_last", "n_messages",
                       F.array_join("ai_tags", ",").alias("tags"))


@query("snapshot", f"""
    WITH {CHAT_SQL}
    SELECT count(*) AS threads, count(nullif(len(ai_tags) > 0, false)) AS tagged,
           (SELECT count(*) FROM customer) AS users, true AS verified FROM chat
""")
def snapshot(spark, sf):
    """Take a verified snapshot of the chat archive and describe the version."""
    from threadlens.session import scratch

    threads, _ = chat_threads(spark, sf)
    root = scratch(spark, "snapshots")
    version = store.snapshot(
        spark, {"threads": threads, "users": adapters.mapped(spark, sf, "users")}, root
    )
    opened = store.verify(spark, root, version)
    same = F.lit(True)
    for name, n in opened.items():
        same = same & (F.col(name) == F.lit(n))
    return store.versions(spark, root).filter(F.col("version") == version).select(
        "threads", "tagged", "users", same.alias("verified")
    )


# Thread predicates --------------------------------------------------------------

@query("f_date_from", f"""
    WITH {header_sql('line_messages')}
    SELECT user_id, thread_id FROM kept GROUP BY ALL HAVING bool_or(date >= '1999-06-01')
""")
def f_date_from(spark, sf):
    threads = th.build_threads(kept_messages(spark, sf, "line_messages"))
    return threads.filter(search.some_day_from(F.lit("1999-06-01"), F.col("day_max"))).select(*KEY)


@query("f_date_to", f"""
    WITH {header_sql('chat_messages')}
    SELECT user_id, thread_id FROM kept GROUP BY ALL
    HAVING bool_or(substring(date, 1, 10) <= '2024-04-10')
""")
def f_date_to(spark, sf):
    threads = th.build_threads(kept_messages(spark, sf, "chat_messages"))
    return threads.filter(search.some_day_to(F.lit("2024-04-10"), F.col("day_min"))).select(*KEY)


@query("f_date_window", f"""
    WITH {header_sql('line_messages')}
    SELECT user_id, thread_id FROM kept GROUP BY ALL
    HAVING bool_or(substring(date, 1, 10) >= '1998-01-01') AND bool_or(substring(date, 1, 10) <= '1997-12-31')
""")
def f_date_window(spark, sf):
    """Two bounds that different messages of a thread may satisfy."""
    threads = th.build_threads(kept_messages(spark, sf, "line_messages"))
    return threads.filter(
        search.some_day_from(F.lit("1998-01-01"), F.col("day_max"))
        & search.some_day_to(F.lit("1997-12-31"), F.col("day_min"))
    ).select(*KEY)


@query("f_has_attachments", f"""
    WITH {header_sql('chat_messages')} SELECT user_id, thread_id FROM head WHERE has_attachments
""")
def f_has_attachments(spark, sf):
    threads, _ = chat_threads(spark, sf)
    return threads.filter(search.with_attachments(F.lit(True), F.col("has_attachments"))).select(*KEY)


@query("f_has_multiple", f"""
    WITH {header_sql('line_messages')} SELECT user_id, thread_id FROM head WHERE n_messages > 1
""")
def f_has_multiple(spark, sf):
    threads = th.build_threads(kept_messages(spark, sf, "line_messages"))
    return threads.filter(search.with_replies(F.lit(True), F.col("n_messages"))).select(*KEY)


@query("f_min_size", f"""
    WITH {_ATTACH_SQL}
    SELECT user_id, thread_id FROM att GROUP BY ALL HAVING bool_or(size >= 10 * 1000)
""")
def f_min_size(spark, sf):
    columns = att.per_thread(att.attach(*_attachments(spark, sf)))
    return columns.filter(
        search.some_attachment_of(F.lit(10), F.col("max_attachment_size"))
    ).select(*KEY)


@query("f_size_label", """
    SELECT doc_id, kb FROM (
        SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN 500 WHEN 3 THEN 1000
            WHEN 4 THEN 5000 END AS kb, n_chars FROM documents)
    WHERE kb IS NULL OR n_chars >= kb * 1000
""")
def f_size_label(spark, sf):
    d = adapters.table(spark, sf, "documents")
    label = F.element_at(
        F.array(*[F.lit(x) for x in ("small", "medium", "large", "xlarge", "huge", "other")]),
        (F.col("doc_id") % 6 + 1).cast("int"),
    )
    kb = values.size_label_kb(label)
    return d.filter(search.some_attachment_of(kb, F.col("n_chars"))).select(
        "doc_id", kb.cast("int").alias("kb")
    )
