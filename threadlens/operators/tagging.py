"""Tag requests, replies and tag tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threadlens.functions.tags import (
    EDIT_LENGTH, EDIT_LIMIT, clean_tags, parse_tags,
)
from threadlens.functions.text import TEXT_CAP, tokens
from threadlens.schemas import KEY
from threadlens.session import materialise

# Fixed values -----------------------------------------------------------
GROUP_SIZE = 10
BATCH_FROM = 50
# ------------------------------------------------------------------------

GROUP = ["user_id", "group_id"]


def untagged(threads: DataFrame) -> DataFrame:
    return threads.filter(F.col("ai_tags").isNull() | (F.size("ai_tags") == 0))


def tag_groups(pending: DataFrame, size: int = GROUP_SIZE, slices: int = 256) -> DataFrame:
    """Chunks of ``size`` threads per user: ``group_id`` = g0, g1, … and ``pos``.

    Numbering is per ``(user, slice of thread ids)`` plus the count of the
    slices before, so one very large mailbox is numbered by many tasks. The
    slices are id ranges by hash; every group but the last is full.
    """
    sliced = pending.withColumn("slice", F.pmod(F.xxhash64("thread_id"), F.lit(slices)))
    within = Window.partitionBy("user_id", "slice").orderBy("thread_id")
    before = (
        Window.partitionBy("user_id").orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        sliced.groupBy("user_id", "slice").agg(F.count("*").alias("n"))
        .select("user_id", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    number = F.col("offset") + F.col("within") - 1
    return (
        sliced.withColumn("within", F.row_number().over(within))
        .join(offsets, ["user_id", "slice"])
        .withColumns({
            "group_no": F.floor(number / size).cast("bigint"),
            "pos": (number % size).cast("bigint"),
        })
        .withColumn("group_id", F.concat(F.lit("g"), "group_no"))
        .drop("slice", "within", "offset")
    )


def route(pending: DataFrame, threshold: int = BATCH_FROM) -> DataFrame:
    """Per user: how many threads wait, and whether they go as a batch."""
    return pending.groupBy("user_id").agg(F.count("*").alias("pending")).withColumn(
        "route", F.when(F.col("pending") >= threshold, "batch").otherwise("direct")
    )


def tag_inputs(threads: DataFrame, content: DataFrame) -> DataFrame:
    """The single-valued part of what the tagger reads about a thread.

    Participants and attachments stay rows of their own (see request_lines).
    """
    return (
        threads.select(*KEY, "subject", F.col("date_first").alias("date"))
        .join(content.select(*KEY, "body_text", "body_scan_status"), KEY, "left")
        .withColumns({
            "body_text": F.coalesce("body_text", F.lit("")),
            "body_scan_status": F.coalesce("body_scan_status", F.lit("ok")),
        })
    )


def attachment_lines(attachments: DataFrame, limit: int = TEXT_CAP) -> DataFrame:
    """One line of request text per attachment, by scan status."""
    text = F.coalesce("text", F.lit(""))
    note = (
        F.when(F.col("scan_status") == "unsupported", " [type not read]")
        .when(F.col("scan_status") == "failed", " [no text]")
        .when(F.col("scan_status") == "truncated",
              F.concat(F.lit(f" [first {limit} characters] "), text))
        .otherwise(F.concat(F.lit(" "), text))
    )
    return attachments.select(
        *KEY, F.concat_ws("/", "message_id", "attachment_id").alias("at"),
        F.concat(F.lit("file: "), "name", note).alias("line"),
    )


def request_lines(
    groups: DataFrame, inputs: DataFrame, participants: DataFrame,
    attachments: DataFrame | None = None, limit: int = TEXT_CAP,
) -> DataFrame:
    """The request of every group as ordered lines.

    Order within a group: ``pos, section, at``. Lines rather than one string,
    so a thread with very many participants or files stays many rows.
    """
    place = groups.select(*KEY, "group_id", "pos")
    cut = F.when(
        F.col("body_scan_status") == "truncated", f" (first {limit} characters)"
    ).otherwise("")
    texts = {
        0: F.concat(F.lit("# thread "), F.col("pos").cast("string")),
        1: F.concat(F.lit("subject: "), F.coalesce("subject", F.lit(""))),
        3: F.concat(F.lit("started: "), F.coalesce("date", F.lit(""))),
        4: F.concat(F.lit("text"), cut, F.lit(": "), "body_text"),
    }
    sections = F.array(*[
        F.struct(F.lit(n).alias("section"), line.alias("line")) for n, line in texts.items()
    ])
    head = inputs.join(place, KEY).select(*KEY, F.explode(sections).alias("s")).select(
        *KEY, "s.section", F.lit("").alias("at"), "s.line"
    )
    people = participants.select(
        *KEY, F.lit(2).alias("section"), F.col("address").alias("at"),
        F.concat(F.lit("person: "), "address").alias("line"),
    )
    rows = head.unionByName(people)
    if attachments is not None:
        files = attachment_lines(attachments, limit).withColumn("section", F.lit(5))
        rows = rows.unionByName(files.select(*KEY, "section", "at", "line"))
    return rows.join(place, KEY).select(*GROUP, "pos", "thread_id", "section", "at", "line")


def build_requests(lines: DataFrame) -> DataFrame:
    """One request text per group of ten threads, with its size.

    A tagger that takes rows reads :func:`request_lines` instead.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "section", "at", "line")))
    return lines.groupBy(*GROUP).agg(
        F.sum(F.length("line") + 1).alias("chars"), F.count("*").alias("n_lines"),
        F.count_distinct("pos").alias("n_threads"),
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("request"),
    )


def frequent_token_tagger(lines: DataFrame, top: int = 12) -> DataFrame:
    """The default tagger: the most frequent longer tokens of each thread.

    Stands where a model would: it reads request lines and answers with one
    JSON list of lists per group, so another tagger can be put in its place.
    """
    counted = (
        lines.select(*GROUP, "pos", F.explode(tokens(F.col("line"))).alias("token"))
        .filter(F.length("token") >= 4)
        .groupBy(*GROUP, "pos", "token").agg(F.count("*").alias("n"))
    )
    rank = Window.partitionBy(*GROUP, "pos").orderBy(F.col("n").desc(), "token")
    best = counted.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= top)
    tags = best.groupBy(*GROUP, "pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x["token"])
        .alias("tags")
    )
    empty = F.array().cast("array<string>")
    return (
        lines.filter(F.col("section") == 0).select(*GROUP, "pos")
        .join(tags, [*GROUP, "pos"], "left")
        .groupBy(*GROUP)
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("tags", empty).alias("tags"))))
             .alias("rows"))
        .select(*GROUP, F.to_json(F.transform("rows", lambda x: x["tags"])).alias("reply"))
    )


def join_replies(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Tags of each thread by its place in the group.

    ``batches(user_id, batch_id, group_id, pos, thread_id)`` against
    ``replies(batch_id, group_id, status, reply)``. Unknown groups and groups
    that did not succeed contribute nothing.
    """
    keys = ["batch_id", "group_id"]
    sizes = batches.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    parsed = (
        replies.filter(F.col("status") == "succeeded").join(sizes, keys)
        .select(*keys, F.posexplode(parse_tags(F.col("reply"), F.col("n"))).alias("pos", "entry"))
        .select(*keys, F.col("pos").cast("bigint").alias("pos"), "entry.tags", "entry.truncated")
    )
    return batches.join(parsed, [*keys, "pos"]).select(
        *KEY, "batch_id", "group_id", "tags", "truncated"
    )


def remainder(batches: DataFrame, tagged: DataFrame) -> DataFrame:
    """Threads of a batch that no reply covered."""
    return batches.join(tagged.select(*KEY), KEY, "left_anti")


def last_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``; equal ones are settled by their content."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    first = [F.col(order)] if order in rows.columns else []
    best = rows.groupBy(*keys).agg(F.max(F.struct(*first, *rest)).alias("_last"))
    return best.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def set_tags(threads: DataFrame, tags: DataFrame, order: str = "seq") -> DataFrame:
    """Overwrite tags and flag where given; an empty list is allowed.

    Of several rows for a thread the one with the greatest ``order`` counts.
    """
    kept = tags.select(*KEY, "tags", "truncated", *[c for c in (order,) if c in tags.columns])
    given = last_rows(kept, KEY, order).select(
        *KEY, F.col("tags").alias("new_tags"), F.col("truncated").alias("new_truncated"),
        F.lit(True).alias("given"),
    )
    hit = F.coalesce("given", F.lit(False))
    return threads.join(given, KEY, "left").withColumns({
        "ai_tags": F.when(hit, F.col("new_tags")).otherwise(F.col("ai_tags")),
        "tags_truncated": F.when(hit, F.col("new_truncated")).otherwise(F.col("tags_truncated")),
    }).drop("new_tags", "new_truncated", "given")


def edit_tags(threads: DataFrame, edits: DataFrame, order: str = "seq") -> DataFrame:
    """Apply ``edits(user_id, thread_id, add, remove)`` to own tags.

    Several edits of a thread are applied one after the other, by ``order``; of one
    edit the removals come first. Requests with more than twenty tags are refused as
    a whole; tags are cut at sixty characters. Edits of unknown threads have no effect.

    What an edit does to one tag is a row of its own. A tag stays that was there and
    never removed; a tag comes that was added in or after its last removal, at the
    place of the first such edit. Both are aggregates per (thread, tag), combined
    before the shuffle, so a thread with any number of edits is no list of them.
    """
    empty = F.array().cast("array<string>")
    cut = lambda col: F.transform(F.coalesce(col, empty), lambda t: F.substring(t, 1, EDIT_LENGTH))
    valid = edits.withColumns({"add": cut(F.col("add")), "remove": cut(F.col("remove"))}).filter(
        F.size("add") + F.size("remove") <= EDIT_LIMIT
    )
    first = F.col(order) if order in edits.columns else F.lit(0)
    acts = valid.select(
        *KEY, first.alias("at"), clean_tags(F.col("add"), EDIT_LIMIT).alias("plus"),
        clean_tags(F.col("remove"), EDIT_LIMIT).alias("minus"),
    ).withColumn("at", F.struct("at", "plus", "minus"))  # edits of one order are settled by their content
    tag_key = [*KEY, "tag"]
    removed = acts.select(*KEY, "at", F.explode("minus").alias("tag")).groupBy(*tag_key).agg(F.max("at").alias("gone"))
    removed = materialise(removed, "removed")
    added = (
        acts.select(*KEY, "at", F.posexplode("plus").alias("i", "tag")).groupBy(*tag_key, "at").agg(F.min("i").alias("i"))
        .join(removed, tag_key, "left").filter(F.col("gone").isNull() | (F.col("at") >= F.col("gone")))
        .groupBy(*tag_key).agg(F.min(F.struct("at", "i")).alias("since"))
    )
    own = threads.select(*KEY, F.posexplode(F.coalesce("user_tags", empty)).alias("i", "own")).withColumn(
        "tag", F.lower("own"))
    kept = own.join(removed.select(*tag_key), tag_key, "left_anti")
    new = added.join(kept.select(*tag_key).distinct(), tag_key, "left_anti")
    listed = lambda df, by, tag: df.groupBy(*KEY).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), F.col(tag).alias("tag")))), lambda x: x["tag"]))
    kept_lists = listed(kept, "i", "own").toDF(*KEY, "kept")
    new_lists = listed(new, "since", "tag").toDF(*KEY, "new")
    touched = acts.select(*KEY).distinct().withColumn("touched", F.lit(True))
    hit = F.coalesce("touched", F.lit(False))
    return (
        threads.join(touched, KEY, "left").join(kept_lists, KEY, "left").join(new_lists, KEY, "left").withColumns({
            "user_tags": F.when(hit, F.concat(F.coalesce("kept", empty), F.coalesce("new", empty))).otherwise(
                F.coalesce("user_tags", empty)),
            "manually_reviewed": F.when(hit, F.lit(True)).otherwise(F.col("manually_reviewed")),
        }).drop("touched", "kept", "new")
    )


def cleanup(threads: DataFrame) -> DataFrame:
    """Threads with both tag lists normalised, and what each list lost."""
    out = threads
    for col in ("ai_tags", "user_tags"):
        old = F.coalesce(col, F.array().cast("array<string>"))
        new = clean_tags(old)
        out = out.withColumns({
            f"{col}_changed": (new != old), f"{col}_removed": (F.size(old) - F.size(new)),
            col: F.when(new != old, new).otherwise(F.col(col)),
        })
    return out


def cleanup_stats(threads: DataFrame) -> DataFrame:
    """Dry run of :func:`cleanup`: scanned, lists changed, tags removed."""
    done = cleanup(threads)
    return done.agg(
        F.count("*").alias("scanned"),
        (F.count_if("ai_tags_changed") + F.count_if("user_tags_changed")).alias("changed"),
        F.coalesce(F.sum(F.when(F.col("ai_tags_changed"), F.col("ai_tags_removed")).otherwise(0)
                         + F.when(F.col("user_tags_changed"), F.col("user_tags_removed")).otherwise(0)),
                   F.lit(0)).alias("removed"),
    )


def retag(
    threads: DataFrame, messages: DataFrame, participants: DataFrame, content_of, tagger=None
) -> DataFrame:
    """Tag every untagged thread whose messages still exist: keys, tags, truncated."""
    tagger = tagger or frequent_token_tagger
    empty = untagged(threads)
    alive = materialise(
        content_of(messages.join(empty.select(*KEY), KEY, "left_semi")), "content"
    )
    pending = empty.join(alive.select(*KEY), KEY, "left_semi")
    groups = materialise(tag_groups(pending.select(*KEY)), "groups")
    people = participants.join(pending.select(*KEY), KEY, "left_semi")
    lines = request_lines(groups, tag_inputs(pending, alive), people)
    replies = tagger(lines).select(
        F.col("user_id").alias("batch_id"), "group_id", F.lit("succeeded").alias("status"), "reply"
    )
    batches = groups.withColumn("batch_id", F.col("user_id"))
    return join_replies(batches, replies)
