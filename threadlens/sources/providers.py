"""Raw provider payloads (JSON text) to normalised rows.

Input is ``raw(user_id, payload, arrival_seq)`` with one message per row. Two
payload families are read: one with a flat JSON message, one with a MIME part
tree and a header list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadlens.session import materialise, rows_of

# Fixed values -----------------------------------------------------------
EXCLUDED_LABELS = ["SPAM", "TRASH", "DRAFT"]
GRAPH_MESSAGE = """
    id string, conversationId string, subject string,
    `from` struct<emailAddress: struct<address: string>>,
    toRecipients array<struct<emailAddress: struct<address: string>>>,
    receivedDateTime string, hasAttachments boolean,
    body struct<content: string>, bodyPreview string, webLink string, parentFolderId string
"""
GRAPH_ATTACHMENTS = """
    value array<struct<id: string, name: string, contentType: string, size: bigint>>
"""
# Fields of a part and the type each is read as.
PART_FIELDS = {
    "mimeType": "string", "filename": "string", "headers": "array<variant>", "body": "map<string, variant>",
    "body.data": "string", "body.attachmentId": "string", "body.size": "bigint", "parts": "array<variant>",
}
MIME_DEPTH = 8
ADDRESS = r"<([^<>]*)>"
LINK = "https://mail.google.com/mail/"
# ------------------------------------------------------------------------


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _filled(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def normalise_graph(raw: DataFrame) -> DataFrame:
    """Flat JSON messages to the message shape; rows without an id are dropped.

    Unreadable payloads are in :func:`quarantine` with ``GRAPH_MESSAGE``.
    """
    m = raw.select("user_id", "arrival_seq", readable(F.col("payload"), GRAPH_MESSAGE).alias("m"))
    to = F.transform(
        F.coalesce("m.toRecipients", F.array()), lambda r: r["emailAddress"]["address"]
    )
    return m.filter(_or_empty(F.col("m.id")) != "").select(
        "user_id", F.col("m.id").alias("message_id"),
        F.coalesce(_filled(F.col("m.conversationId")), "m.id").alias("thread_id"),
        _or_empty(F.col("m.subject")).alias("subject"),
        _or_empty(F.col("m.from.emailAddress.address")).alias("from_addr"),
        F.filter(to, lambda a: _or_empty(a) != "").alias("to_addrs"),
        _or_empty(F.col("m.receivedDateTime")).alias("date"),
        F.coalesce("m.hasAttachments", F.lit(False)).alias("has_attachments"),
        F.coalesce(_filled(F.col("m.body.content")), "m.bodyPreview", F.lit("")).alias("body"),
        _or_empty(F.col("m.webLink")).alias("web_link"),
        _or_empty(F.col("m.parentFolderId")).alias("container_id"),
        "arrival_seq",
    )


def normalise_attachments(raw: DataFrame) -> DataFrame:
    """``raw(user_id, message_id, payload)``: attachment lists to metadata rows."""
    items = raw.select(
        "user_id", "message_id", F.explode(readable(F.col("payload"), GRAPH_ATTACHMENTS)["value"]).alias("a")
    )
    return items.filter(_or_empty(F.col("a.id")) != "").select(
        "user_id", "message_id", F.col("a.id").alias("attachment_id"), _or_empty(F.col("a.name")).alias("name"),
        F.lower(_or_empty(F.col("a.contentType"))).alias("content_type"),
        F.coalesce("a.size", F.lit(0).cast("bigint")).alias("size"),
    )


def decode_b64(col: Column) -> Column:
    """Bytes of base64 or unpadded base64url text; null when undecodable or empty."""
    # Bytes are replaced, since translate makes a string of every character.
    plain = F.replace(F.replace(col, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    padded = F.rpad(plain, (F.ceil(F.length(col) / 4) * 4).cast("int"), F.lit("="))
    return F.when(F.length(col) > 0, F.try_to_binary(padded, F.lit("base64")))


def decode_content(raw: DataFrame) -> DataFrame:
    """``raw(user_id, message_id, attachment_id, encoded)`` to bytes; bad pairs are dropped."""
    return raw.select(
        "user_id", "message_id", "attachment_id", decode_b64(F.col("encoded")).alias("content")
    ).filter(F.col("content").isNotNull() & (F.octet_length("content") > 0))


def header(headers: Column, name: str) -> Column:
    """First header with this name in any case, else the empty string."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return _or_empty(F.get(hits, F.lit(0))["value"])


def quarantine(raw: DataFrame, schema: str, *keys: str) -> DataFrame:
    """Rows whose ``payload`` cannot be read as ``schema``: ``keys``, the payload and an error.

    The parsers leave such rows out. A caller stores them and does not move the
    cursor of their source, so that the range is asked for again.
    """
    return raw.filter(unreadable(F.col("payload"), schema)).select(
        *keys, "payload", F.when(F.col("payload").isNull(), "no payload").otherwise("malformed payload").alias("error")
    )


def readable(payload: Column, schema: str) -> Column:
    """The parsed payload; null for text that is no JSON object of this shape."""
    marked = f"{schema[:-1]}, _unread: string>" if schema.startswith("struct<") else f"{schema}, _unread string"
    parsed = F.from_json(payload, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    return F.when(parsed["_unread"].isNull(), parsed)


def unreadable(payload: Column, schema: str) -> Column:
    return readable(payload, schema).isNull()


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}" if path else "$", kind)


def _lost(part: Column) -> Column:
    """Names of the fields that a part has but that cannot be read as what they are."""
    # Tests that hold for good parts come first: the others copy all that lies below.
    whole = F.when(_get(part, "mimeType", "string").isNull() & ~F.is_variant_null(part)
                   & _get(part, "", "map<string, variant>").isNull(), F.lit("part"))
    fields = []
    for name, kind in PART_FIELDS.items():
        given = _get(part, name, "variant")
        fields.append(F.when(_get(part, name, kind).isNull() & given.isNotNull() & ~F.is_variant_null(given), F.lit(name)))
    return F.array_compact(F.array(whole, *fields))


def _headers(part: Column) -> Column:
    return F.transform(_get(part, "headers", PART_FIELDS["headers"]), lambda h: F.struct(
        _get(h, "name", "string").alias("name"), _get(h, "value", "string").alias("value")))


def _flattened(part: Column, visit: Column, depth: int) -> Column:
    """array of the part and everything below it, ``depth`` levels deep."""
    get = {name: _get(part, name, kind) for name, kind in PART_FIELDS.items()}
    more = get["parts"]
    here = F.array(F.struct(
        visit.alias("visit"), get["mimeType"].alias("mimeType"),
        get["filename"].alias("filename"), _headers(part).alias("headers"),
        F.struct(get["body.data"].alias("data"), get["body.attachmentId"].alias("attachmentId"),
                 get["body.size"].alias("size")).alias("body"),
        _lost(part).alias("lost"),
        (more if depth == 1 else F.lit(None).cast("array<variant>")).alias("deeper"),
    ))
    if depth == 1:
        return here
    below = F.transform(
        more, lambda p, i: _flattened(p, F.concat(visit, F.array(-i)), depth - 1)
    )
    return F.flatten(F.concat(F.array(here), F.coalesce(below, F.array())))


def tree(payload: Column) -> Column:
    """A payload as VARIANT; null for text that is no JSON object."""
    # A list of one is filtered: when() would parse for its test and once more for its value.
    objects = F.filter(F.array(F.try_parse_json(payload)), lambda v: _get(v, "", "map<string, variant>").isNotNull())
    return F.get(objects, F.lit(0))


def mime_parts(raw: DataFrame, depth: int = MIME_DEPTH) -> DataFrame:
    """All parts of each message, root included, with their visiting order.

    ``raw(user_id, message_id, payload)`` with the part tree as JSON text or VARIANT.
    The last sibling is visited first, after its parent and before its earlier
    siblings. ``visit`` is the path from the root, an array that sorts in that
    order. A tree is flattened ``depth`` levels at a time inside its row, as deep as
    it is. A field of another type than it should have costs that field alone, at any
    depth; ``lost`` names such fields. :func:`quarantine_parts` lists them, and the
    payloads that are no trees.
    """
    text = raw.schema["payload"].dataType.simpleString() == "string"
    todo = raw.select(
        "user_id", "message_id", F.array().cast("array<int>").alias("visit"),
        (tree(F.col("payload")) if text else F.col("payload")).alias("part"),
    )
    out = None
    while True:
        # No filter on ``part``: Spark would move it below the parsing, which it then repeats.
        lists = F.when(F.col("part").isNotNull(), _flattened(F.col("part"), F.col("visit"), depth))
        flat = materialise(rows_of(
            todo.select("user_id", "message_id", lists.alias("lists")),
            "user_id", "message_id", name="p", lists="lists",
        ).select("user_id", "message_id", "p.*"), "parts")
        out = flat.drop("deeper") if out is None else out.unionByName(flat.drop("deeper"))
        below = flat.filter(F.size("deeper") > 0)
        if below.isEmpty():
            return out
        todo = below.select(
            "user_id", "message_id", F.col("visit").alias("above"), F.posexplode("deeper").alias("i", "part"),
        ).select("user_id", "message_id", F.concat("above", F.array(-F.col("i"))).alias("visit"), "part")


def quarantine_parts(raw: DataFrame, parts: DataFrame) -> DataFrame:
    """(user_id, message_id, error): one row for each message of which something could not be read.

    ``parts`` are the :func:`mime_parts` of ``raw``, which leave out payloads that are
    no trees and single fields of a wrong type.
    """
    key = ["user_id", "message_id"]
    no_tree = raw.filter(tree(F.col("payload")).isNull()).select(
        *key, F.when(F.col("payload").isNull(), "no payload").otherwise("malformed payload").alias("error"))
    # There are a handful of field names, however many parts a message has.
    fields = parts.select(*key, F.explode("lost").alias("field")).distinct().groupBy(*key).agg(
        F.concat(F.lit("unreadable: "), F.array_join(F.array_sort(F.collect_list("field")), ", ")).alias("error"))
    return no_tree.unionByName(fields)


def mime_body(parts: DataFrame) -> DataFrame:
    """Best body per message: first HTML part, else first other text part."""
    # Bytes that are not UTF-8 become replacement characters.
    text = F.make_valid_utf8(decode_b64(F.col("body.data")).cast("string"))
    mime = F.lower(_or_empty(F.col("mimeType")))
    bodies = (
        parts.filter(_or_empty(F.col("filename")) == "")
        .filter(F.startswith(mime, F.lit("text/")))
        .select("user_id", "message_id", "visit", mime.alias("mime"), text.alias("text"))
    )
    # One text a message is kept; empty ones are left out here, where they are decoded already.
    rank = F.struct((F.col("mime") != "text/html").alias("other"), "visit")
    return bodies.groupBy("user_id", "message_id").agg(
        F.min_by("text", F.when(F.col("text") != "", rank)).alias("body")
    ).filter(F.col("body").isNotNull())


def mime_attachments(parts: DataFrame) -> DataFrame:
    """Metadata of parts that have both a file name and an attachment id."""
    return parts.filter(
        (_or_empty(F.col("filename")) != "") & (_or_empty(F.col("body.attachmentId")) != "")
    ).select(
        "user_id", "message_id", F.col("body.attachmentId").alias("attachment_id"),
        F.col("filename").alias("name"), F.lower(_or_empty(F.col("mimeType"))).alias("content_type"),
        F.coalesce("body.size", F.lit(0).cast("bigint")).alias("size"),
    )


def first_address(text: Column) -> Column:
    """The address of ``Name <addr>`` or of a bare ``addr``."""
    return F.coalesce(
        _filled(F.trim(F.regexp_extract(text, ADDRESS, 1))),
        F.when(F.contains(text, F.lit("@")), F.trim(text)), F.lit(""),
    )


def address_list(text: Column) -> Column:
    """Addresses of a comma-separated header; commas inside quotes are text."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    return F.filter(F.transform(F.split(bare, ","), first_address), lambda a: a != "")


def normalise_gmail(raw: DataFrame, accounts: DataFrame, depth: int = MIME_DEPTH) -> DataFrame:
    """MIME-tree messages to the message shape.

    ``accounts(user_id, account)`` gives the address that links are pinned to,
    one row per user; users without a row get the general link.
    """
    whole = raw.select("user_id", "arrival_seq", tree(F.col("payload")).alias("m"))
    m = whole.select(
        "user_id", "arrival_seq", _get(F.col("m"), "id", "string").alias("message_id"),
        _get(F.col("m"), "threadId", "string").alias("threadId"),
        _get(F.col("m"), "labelIds", "array<string>").alias("labelIds"),
        _get(F.col("m"), "internalDate", "string").alias("internalDate"),
        _get(F.col("m"), "payload", "variant").alias("payload"),
    ).filter(_or_empty(F.col("message_id")) != "")
    parts = mime_parts(m.select("user_id", "message_id", "payload"), depth)
    bodies = mime_body(parts)
    flags = mime_attachments(parts).select("user_id", "message_id").distinct().withColumn(
        "has_attachments", F.lit(True)
    )
    heads = _headers(F.col("payload"))
    stamp = F.timestamp_millis(F.col("internalDate").try_cast("bigint"))
    millis = F.pmod(F.col("internalDate").try_cast("bigint"), F.lit(1000))
    date = F.concat(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(millis != 0, F.date_format(stamp, ".SSS000")).otherwise(""), F.lit("+00:00"),
    )
    labels = F.coalesce("labelIds", F.array().cast("array<string>"))
    excluded = F.filter(labels, lambda l: l.isin(EXCLUDED_LABELS))
    account = _or_empty(F.col("account"))
    link = F.when(
        account != "", F.concat(F.lit(f"{LINK}?authuser="), account, F.lit("#all/"), "message_id")
    ).otherwise(F.concat(F.lit(f"{LINK}u/0/#all/"), "message_id"))
    key = ["user_id", "message_id"]
    return (
        m.join(bodies, key, "left").join(flags, key, "left").join(accounts, "user_id", "left")
        .select(
            "user_id", "message_id",
            F.coalesce(_filled(F.col("threadId")), "message_id").alias("thread_id"),
            header(heads, "Subject").alias("subject"),
            first_address(header(heads, "From")).alias("from_addr"),
            address_list(header(heads, "To")).alias("to_addrs"),
            _or_empty(date).alias("date"),
            F.coalesce("has_attachments", F.lit(False)).alias("has_attachments"),
            _or_empty(F.col("body")).alias("body"), link.alias("web_link"),
            F.coalesce(F.get(excluded, F.lit(0)), F.get(labels, F.lit(0)), F.lit(""))
            .alias("container_id"),
            "arrival_seq",
        )
    )
