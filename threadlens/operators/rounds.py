"""Multi-round searches: merging, accumulating, summarising, citing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threadlens.functions.text import fold_subject
from threadlens.schemas import KEY
from threadlens.session import materialise, spread_if_small

# Fixed values -----------------------------------------------------------
LIST_BELOW = 100
SHOWN = 5
MIN_CONTAINED = 12
#: Characters of the runs that are sampled from texts.
RUN = 8
# ------------------------------------------------------------------------

ROUND = ["session_id", "round"]


def merge_round(hits: DataFrame) -> DataFrame:
    """Each thread of a round once, under the first query that found it.

    Within a query hits are ordered by ``(date_last desc, thread_id)``, which
    is a property of the thread, so the first occurrence is simply the lowest
    query id and no list has to be ranked.
    """
    return hits.groupBy(*ROUND, *KEY).agg(
        F.min("query_id").alias("query_id"), F.any_value("date_last").alias("date_last")
    )


def accumulate(merged: DataFrame) -> DataFrame:
    """Each thread of a session once, with the round that found it first."""
    return merged.groupBy("session_id", *KEY).agg(F.min("round").alias("first_round"))


def new_in_round(merged: DataFrame, earlier: DataFrame) -> DataFrame:
    """Rows of a round whose thread no earlier round found."""
    return merged.join(earlier.select("session_id", *KEY).distinct(), ["session_id", *KEY], "left_anti")


def top_n(merged: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first ``n`` rows of every round and how many more there are."""
    order = Window.partitionBy(*ROUND).orderBy("query_id", F.col("date_last").desc(), "thread_id")
    shown = merged.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    counts = merged.groupBy(*ROUND).agg(F.count("*").alias("found"))
    return shown.join(counts, ROUND).withColumn(
        "more", F.greatest(F.col("found") - n, F.lit(0).cast("bigint"))
    )


def round_summary(
    merged: DataFrame, queries: DataFrame, threads: DataFrame, list_below: int = LIST_BELOW
) -> DataFrame:
    """One row per round: count, listing (short rounds only), failed queries.

    ``queries`` may carry ``failed``; a failed query is unknown, not empty, and
    is counted apart. Only rounds below ``list_below`` rows are listed, which
    bounds the rows gathered per round.
    """
    asked = queries if "failed" in queries.columns else queries.withColumn("failed", F.lit(False))
    rounds = asked.groupBy(*ROUND).agg(
        F.count("*").alias("asked"), F.count_if("failed").alias("failed")
    )
    counts = merged.groupBy(*ROUND).agg(F.count("*").alias("found"))
    short = merged.join(counts.filter(F.col("found") < list_below), ROUND).join(
        threads.select(*KEY, "subject", "date_first"), KEY
    )
    line = F.concat_ws(
        " | ",
        F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("(no subject)")),
        F.substring("date_first", 1, 10),
    )
    key = F.struct(
        F.col("query_id"), F.col("date_last"), F.col("thread_id"), line.alias("line")
    )
    listing = (
        short.groupBy(*ROUND).agg(F.collect_list(key).alias("rows"))
        .select(
            *ROUND,
            F.array_join(
                F.transform(
                    F.array_sort(
                        "rows",
                        lambda a, b: F.when(a["query_id"] < b["query_id"], -1)
                        .when(a["query_id"] > b["query_id"], 1)
                        .when(a["date_last"] > b["date_last"], -1)
                        .when(a["date_last"] < b["date_last"], 1)
                        .when(a["thread_id"] < b["thread_id"], -1)
                        .when(a["thread_id"] > b["thread_id"], 1).otherwise(0),
                    ),
                    lambda r: r["line"],
                ),
                "\n",
            ).alias("listing"),
        )
    )
    found = F.coalesce("found", F.lit(0).cast("bigint"))
    return (
        rounds.join(counts, ROUND, "left").join(listing, ROUND, "left")
        .select(
            *ROUND, "asked", "failed", found.alias("found"),
            F.when(found == 0, "none").when(found >= list_below, "count").otherwise("list")
            .alias("kind"),
            F.coalesce("listing", F.lit("")).alias("listing"),
        )
    )


def match_subjects(cited: DataFrame, found: DataFrame) -> DataFrame:
    """The first found thread whose subject answers each cited subject.

    ``cited(session_id, cite_id, cited)`` against
    ``found(session_id, thread_id, subject, found_pos)``. Folded subjects are
    equal, or one contains the other and the shorter has at least 12
    characters. The shorter one is looked up by a sampled run of its own, the
    one rarest among those of the longer side, so only subjects that share such
    a run are compared (:func:`_samples`). Equal subjects are folded into one
    row, with their first position, before that.
    """
    wanted = cited.select("session_id", "cite_id", "cited", fold_subject(F.col("cited")).alias("w"))
    have = (
        found.filter(F.coalesce("subject", F.lit("")) != "")
        .select("session_id", fold_subject(F.col("subject")).alias("h"),
                F.struct("found_pos", "thread_id").alias("at"))
        .groupBy("session_id", "h").agg(F.min("at").alias("at"))
    )
    ids = lambda df, col: df.withColumn("id", F.md5(col)).withColumnRenamed(col, "text")
    # Both sides are read several times below, so they are stored once.
    w = materialise(ids(wanted.select("session_id", "w").distinct(), "w"), "cited")
    h = materialise(ids(have, "h"), "subjects")
    equal = w.join(h.select("session_id", "id", "text", "at"), ["session_id", "id", "text"]).select(
        "session_id", F.col("text").alias("w"), "at"
    )
    inside = _contained(w, h).select("session_id", F.col("short_id").alias("w_id"),
                                     F.col("long_id").alias("h_id"))
    around = _contained(h, w).select("session_id", F.col("long_id").alias("w_id"),
                                     F.col("short_id").alias("h_id"))
    near = (
        inside.unionByName(around)
        .join(w.select("session_id", F.col("id").alias("w_id"), F.col("text").alias("w")),
              ["session_id", "w_id"])
        .join(h.select("session_id", F.col("id").alias("h_id"), "at"), ["session_id", "h_id"])
        .select("session_id", "w", "at")
    )
    best = (
        equal.unionByName(near)
        .groupBy("session_id", "w").agg(F.min("at").alias("at"))
    )
    return wanted.join(best, ["session_id", "w"], "left").select(
        "session_id", "cite_id", "cited", F.col("at.thread_id").alias("thread_id")
    )


def _samples(texts: DataFrame, name: str) -> DataFrame:
    """(session_id, name, sample): the least hash among the runs of each 12-character window.

    A run has 8 characters, so a window holds five. Which one is least depends on
    the window alone: a text that contains another also has all its samples. About
    a third of the runs are samples.

    Texts are cut into overlapping chunks first, in one pass: a position inside
    a short chunk is found quickly, one inside a long text is not.
    """
    n, chunk = MIN_CONTAINED, 64
    texts = spread_if_small(texts, "session_id", "id").select("session_id", F.col("id").alias(name), "text")
    cut = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{chunk + n - 1}}})).{{1,{chunk}}}"), F.lit(1))
    chunks = texts.select("session_id", name, F.explode(cut).alias("chunk")).filter(F.length("chunk") >= n)
    run = lambda at: F.xxhash64(F.col("chunk").substr(at, F.lit(RUN)))
    hashed = chunks.select(
        "session_id", name, F.transform(F.sequence(F.lit(1), F.length("chunk") - RUN + 1), run).alias("runs"))
    held = n - RUN + 1
    at = hashed.select("session_id", name, "runs", F.explode(F.sequence(F.lit(0), F.size("runs") - held)).alias("at"))
    least = lambda first: F.least(*[F.get("runs", F.col("at") + first + k) for k in range(held)])
    # Neighbouring windows mostly have the same least run.
    return at.filter((F.col("at") == 0) | (least(0) != least(-1))).select(
        "session_id", name, least(0).alias("sample"))


def _contained(shorts: DataFrame, longs: DataFrame) -> DataFrame:
    """(session_id, short_id, long_id) where a short text occurs in a longer one.

    Both sides are ``(session_id, id, text)``. Sample rows carry ids only;
    texts come back for the candidate pairs.
    """
    shorts = shorts.filter(F.length("text") >= MIN_CONTAINED)
    longs = longs.filter(F.length("text") > MIN_CONTAINED)
    # Texts no partner of the session can be longer or shorter than drop out.
    longest = longs.groupBy("session_id").agg(F.max(F.length("text")).alias("bound"))
    shortest = shorts.groupBy("session_id").agg(F.min(F.length("text")).alias("bound"))
    shorts = shorts.join(longest, "session_id").filter(F.length("text") < F.col("bound"))
    longs = longs.join(shortest, "session_id").filter(F.length("text") > F.col("bound"))
    key = ["session_id", "sample"]
    # Stored, so their sizes are known and small ones are broadcast to the samples.
    short_samples = materialise(_samples(shorts, "short_id"), "samples")
    # Samples that no short text has are gone before anything is stored or counted.
    shared = materialise(
        _samples(longs, "long_id").join(short_samples.select(*key).distinct(), key, "left_semi"), "shared")
    counts = shared.groupBy(*key).agg(F.count("*").alias("df"))
    anchors = materialise(
        short_samples.join(counts, key, "left")
        .groupBy("session_id", "short_id")
        .agg(
            F.min_by("sample", F.struct("df", "sample")).alias("sample"),
            F.bool_or(F.col("df").isNull()).alias("missing"),
        )
        .filter(~F.col("missing")).drop("missing"), "anchors",
    )
    text = lambda df, side: df.select(
        "session_id", F.col("id").alias(f"{side}_id"), F.col("text").alias(side)
    )
    return (
        shared.join(anchors, key)
        .select("session_id", "short_id", "long_id").distinct()
        .join(text(shorts, "short"), ["session_id", "short_id"])
        .join(text(longs, "long"), ["session_id", "long_id"])
        .filter((F.length("short") < F.length("long")) & F.contains("long", "short"))
        .select("session_id", "short_id", "long_id")
    )
