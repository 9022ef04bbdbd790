"""Searches for all tenants and all saved queries in one job.

A query becomes one or more *units*, each a set of tokens that must all occur:
an all-words query is one unit, an any-word query one unit per word. A unit is
looked up by its rarest token first; the remaining tokens are then joined on
``(thread, token)``, a key no common word can make hot. Phrases are checked by
position, only inside threads that already hold all their tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlens.functions.text import ascii_lower, tokens, words
from threadlens.schemas import KEY
from threadlens.session import materialise

# Fixed values -----------------------------------------------------------
DEFAULT_LIMIT = 200
# Bounds of this library: tokens pushed down as literals, rows broadcast
LITERALS = 500
SMALL = 100_000
# ------------------------------------------------------------------------

UNIT = ["query_id", "unit"]


def _query_words(queries: DataFrame) -> DataFrame:
    """One row per word: query_id, user_id, mode, word_no, tokens."""
    return queries.select(
        "query_id", "user_id", F.coalesce("search_mode", F.lit("and")).alias("mode"),
        F.posexplode(words(F.coalesce("q", F.lit("")))).alias("word_no", "word"),
    ).select("query_id", "user_id", "mode", "word_no", tokens(F.col("word")).alias("tokens"))


def _units(queries: DataFrame) -> DataFrame:
    """Words labelled with their unit; units that can never match are gone.

    A word without tokens is ignored in any-word mode and rules out every row
    in all-words mode.
    """
    all_words = _query_words(queries)
    dead = (
        all_words.filter((F.col("mode") != "or") & (F.size("tokens") == 0))
        .select("query_id").distinct()
    )
    return (
        all_words.join(dead, "query_id", "left_anti")
        .filter(F.size("tokens") > 0)
        .withColumn("unit", F.when(F.col("mode") == "or", F.col("word_no")).otherwise(F.lit(-1)))
    )


class _Index:
    """The index thinned to the tokens of one set of units.

    Units come from queries, which are normally few. One look at them tells: few
    stay with the driver, and their tokens and tenants become literals that the
    Parquet scan prunes with. Others are stored, and broadcast only below
    ``SMALL`` rows.
    """

    def __init__(self, terms: DataFrame, positions: DataFrame, units: DataFrame, statistics: DataFrame | None):
        few = units.limit(LITERALS + 1).collect()
        tokens_of_few = {t for r in few for t in r["tokens"]}
        if len(few) <= LITERALS and len(tokens_of_few) <= LITERALS:
            self.units = units.sparkSession.createDataFrame(few, units.schema)
            self.small, self.phrases = True, any(len(r["tokens"]) > 1 for r in few)
            self.needed = self.units.select(*UNIT, "user_id", F.explode("tokens").alias("token")).distinct()
            tenants = F.col("user_id").isin(sorted({r["user_id"] for r in few if r["user_id"] is not None}))
            wanted = tenants & F.col("token").isin(sorted(tokens_of_few))
            self.of_tenants = terms.filter(tenants)
            self.terms, self.positions = terms.filter(wanted), positions.filter(wanted)
            self.statistics = None if statistics is None else statistics.filter(wanted)
        else:
            self.units = materialise(units, "units")
            self.needed = self.units.select(*UNIT, "user_id", F.explode("tokens").alias("token")).distinct()
            n, widest = self.units.agg(F.sum(F.size("tokens")), F.max(F.size("tokens"))).first()
            self.small, self.phrases = n <= SMALL, widest > 1
            tokens_of = self.hint(self.needed.select("user_id", "token").distinct())
            on = ["user_id", "token"]
            self.terms = terms.join(tokens_of, on, "left_semi")
            self.positions = positions.join(tokens_of, on, "left_semi")
            self.statistics = None if statistics is None else statistics.join(tokens_of, on, "left_semi")
        self.few = len(few) <= LITERALS and len(tokens_of_few) <= LITERALS

    def hint(self, df: DataFrame) -> DataFrame:
        """Broadcast a table that has at most one row per token of a unit."""
        return F.broadcast(df) if self.small else df


def _plans(ix: _Index) -> DataFrame:
    """(query_id, unit, user_id, anchor, n_tokens) of the units whose tokens all occur somewhere."""
    counts = ix.statistics
    if counts is None:
        counts = ix.terms.groupBy("user_id", "token").agg(F.count("*").alias("df"))
    return (
        ix.hint(ix.needed).join(counts, ["user_id", "token"], "left")
        .groupBy(*UNIT, "user_id")
        .agg(
            F.min_by("token", F.struct("df", "token")).alias("anchor"),
            F.count("*").alias("n_tokens"),
            F.bool_or(F.col("df").isNull()).alias("missing"),
        )
        .filter(~F.col("missing")).drop("missing")
    )


def _units_with_all_tokens(ix: _Index) -> DataFrame:
    """(query_id, unit, user_id, thread_id) where every token of the unit occurs.

    With statistics the anchors are known before any posting is read, so the postings
    of the anchors and those of the other tokens are two disjoint reads.
    """
    needed, plans = ix.needed, _plans(ix)
    first = others = ix.terms
    if ix.few and ix.statistics is not None:
        # At most one row a unit, and the units were few enough to be literals.
        known = plans.collect()
        plans = plans.sparkSession.createDataFrame(known, plans.schema)
        anchors = {r["anchor"] for r in known}
        live = {(r["query_id"], r["unit"]) for r in known if r["n_tokens"] > 1}
        anchor_of = {(r["query_id"], r["unit"]): r["anchor"] for r in known}
        rest = {r["token"] for r in needed.collect()
                if (r["query_id"], r["unit"]) in live and anchor_of[r["query_id"], r["unit"]] != r["token"]}
        first = ix.of_tenants.filter(F.col("token").isin(sorted(anchors)))
        if not live:
            found = first.join(F.broadcast(plans.select(*UNIT, "user_id", F.col("anchor").alias("token"))),
                               ["user_id", "token"])
            return found.select(*UNIT, *KEY)
        others = ix.of_tenants.filter(F.col("token").isin(sorted(rest)))
    found = first.join(
        ix.hint(plans.select(*UNIT, "user_id", F.col("anchor").alias("token"), "n_tokens")),
        ["user_id", "token"],
    ).select(*UNIT, *KEY, "n_tokens", "token")
    single = found.filter(F.col("n_tokens") == 1).select(*UNIT, *KEY)
    rest = (
        found.filter(F.col("n_tokens") > 1)
        .withColumnRenamed("token", "anchor")
        .join(ix.hint(needed.select(*UNIT, "token")), UNIT)
        .filter(F.col("token") != F.col("anchor"))
        .join(others, [*KEY, "token"])
        .groupBy(*UNIT, *KEY, "n_tokens").agg(F.count("*").alias("n_found"))
        .filter(F.col("n_found") == F.col("n_tokens") - 1)
        .select(*UNIT, *KEY)
    )
    return single.unionByName(rest)


def _with_phrases(found: DataFrame, ix: _Index) -> DataFrame:
    """Keep units whose multi-token words occur as adjacent tokens."""
    if not ix.phrases:
        return found
    phrases = ix.units.filter(F.size("tokens") > 1)
    found = materialise(found, "candidates")
    per_unit = ix.hint(phrases.groupBy(*UNIT).agg(F.count("*").alias("n_phrases")))
    plain = found.join(per_unit, UNIT, "left_anti")
    steps = phrases.select(
        *UNIT, "word_no", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "token")
    )
    whole = (
        found.join(ix.hint(steps), UNIT)
        .join(ix.positions, [*KEY, "token"])
        .groupBy(*UNIT, *KEY, "word_no", "n", (F.col("pos") - F.col("i")).alias("start"))
        .agg(F.count("*").alias("hits"))
        .filter(F.col("hits") == F.col("n"))
        .groupBy(*UNIT, *KEY).agg(F.count_distinct("word_no").alias("n_whole"))
        .join(per_unit, UNIT)
        .filter(F.col("n_whole") == F.col("n_phrases"))
        .select(*UNIT, *KEY)
    )
    return plain.unionByName(whole)


def match(
    terms: DataFrame, positions: DataFrame, queries: DataFrame, statistics: DataFrame | None = None
) -> DataFrame:
    """(query_id, user_id, thread_id) of all hits; blank queries have none.

    ``statistics`` (see :func:`index.statistics`) names the rarest token of a query;
    without them the postings are counted. Queries asked more than once are looked up once. The hits are stored in the
    shared folder: pages, totals and merges read them, and their known size
    lets joins to the thread table choose well.
    """
    asked = queries.select(
        "query_id", "user_id", F.coalesce("q", F.lit("")).alias("q"),
        F.coalesce("search_mode", F.lit("and")).alias("search_mode"),
    )
    text = ["user_id", "q", "search_mode"]
    first = asked.groupBy(*text).agg(F.min("query_id").alias("first_id"))
    ix = _Index(terms, positions, _units(first.withColumnRenamed("first_id", "query_id")), statistics)
    found = _with_phrases(_units_with_all_tokens(ix), ix)
    once = found.select(F.col("query_id").alias("first_id"), *KEY).distinct()
    copies = asked.join(first, text).select("query_id", "first_id")
    return materialise(once.join(copies, "first_id").select("query_id", *KEY), "hits")


# Filters ------------------------------------------------------------------
#
# "Some message on or after a day" is the same as "the last day is on or
# after it", so the two date bounds become tests on two plain columns.

def with_attachments(flag: Column, has: Column) -> Column:
    return flag.isNull() | (has == flag)


def with_replies(flag: Column, n_messages: Column) -> Column:
    return ~F.coalesce(flag, F.lit(False)) | (n_messages > 1)


def some_day_from(bound: Column, day_max: Column) -> Column:
    return (F.coalesce(bound, F.lit("")) == "") | (day_max >= bound)


def some_day_to(bound: Column, day_min: Column) -> Column:
    return (F.coalesce(bound, F.lit("")) == "") | (day_min <= bound)


def some_attachment_of(kb: Column, max_size: Column) -> Column:
    return kb.isNull() | (kb <= 0) | (F.coalesce(max_size, F.lit(0)) >= kb * 1000)


def swap_reversed(queries: DataFrame) -> DataFrame:
    """Queries with reversed date bounds put in order."""
    both = (F.coalesce("date_from", F.lit("")) != "") & (F.coalesce("date_to", F.lit("")) != "")
    lo, hi = F.col("date_from"), F.col("date_to")
    return queries.withColumns({
        "date_from": F.when(both, F.least(lo, hi)).otherwise(lo),
        "date_to": F.when(both, F.greatest(lo, hi)).otherwise(hi),
    })


WANTED = ["has_attachments", "has_multiple", "date_from", "date_to", "min_attachment_kb"]


def _pass(has_attachments: Column, n_messages: Column, day_min: Column, day_max: Column, size: Column) -> Column:
    """The filters of a query, whose columns are prefixed ``want_``, on the columns of a thread."""
    want = {c: F.col(f"want_{c}") for c in WANTED}
    return (
        with_attachments(want["has_attachments"], has_attachments)
        & with_replies(want["has_multiple"], n_messages)
        & some_day_from(want["date_from"], day_max)
        & some_day_to(want["date_to"], day_min)
        & some_attachment_of(want["min_attachment_kb"], size)
    )


def _holds() -> Column:
    return _pass(*[F.col(c) for c in ("has_attachments", "n_messages", "day_min", "day_max", "max_attachment_size")])


def apply_filters(hits: DataFrame, threads: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits joined to their thread row, where the query's filters hold."""
    wanted = queries.select("query_id", *[F.col(c).alias(f"want_{c}") for c in WANTED])
    return hits.join(threads, KEY).join(wanted, "query_id").filter(_holds()).drop(*[f"want_{c}" for c in WANTED])


def sort_keys(sort_by: str) -> list[Column]:
    """Orders by name; unknown names mean most recently synced first."""
    known = {"date_asc": F.col("date_first").asc(), "date_desc": F.col("date_last").desc()}
    return [known.get(sort_by, F.col("last_synced").desc()), F.col("thread_id").asc()]


def page(df: DataFrame, sort_by: str = "last_synced", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first rows in one of the sort orders."""
    return df.orderBy(*sort_keys(sort_by)).limit(limit)


def pages_per_query(
    hits: DataFrame, limit: int | None = DEFAULT_LIMIT, sort_col: str = "sort_by"
) -> DataFrame:
    """First rows of every query in the query's own order, with ``rank``.

    The rank bound is applied before rows are shuffled by query, so a query
    that matches nearly everything sends ``limit`` rows per task.
    """
    order = F.coalesce(sort_col, F.lit(""))
    up = F.when(order == "date_asc", F.col("date_first"))
    down = F.when(order == "date_desc", F.col("date_last")).when(order != "date_asc", F.col("last_synced"))
    window = Window.partitionBy("query_id").orderBy(up.asc(), down.desc(), F.col("thread_id").asc())
    ranked = hits.withColumn("rank", F.row_number().over(window))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def _blank_results(threads: DataFrame, blank: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """(page keys, totals) of queries without words, which select all threads of their tenant.

    Equal ones are answered once. Threads meet them in the scan: only counts and the
    first rows of each task are shuffled, never the pairs.
    """
    kinds = ["user_id", *[f"want_{c}" for c in WANTED], "sort_by"]
    asked = materialise(blank.select(
        "query_id", "user_id", *[F.col(c).alias(f"want_{c}") for c in WANTED], "sort_by"), "blank")
    # A kind is named by its fields, so that nulls are told apart and joins need no null-safe keys.
    named = asked.withColumn("kind", F.to_json(F.struct(*kinds)))
    once = named.groupBy("kind").agg(*[F.first(c).alias(c) for c in kinds])
    if named.select("kind").distinct().count() <= SMALL:
        once = F.broadcast(once)
    slim = threads.select(*KEY, "has_attachments", "n_messages", "day_min", "day_max", "max_attachment_size", *ORDER)
    pairs = slim.join(once, "user_id").filter(_holds()).withColumnRenamed("kind", "query_id")
    page_ = pages_per_query(pairs.select("query_id", *KEY, *ORDER, "sort_by"), limit).select("query_id", *KEY, "rank")
    totals = pairs.groupBy("query_id").agg(F.count("*").alias("total"))
    ids = named.select("query_id", F.col("kind"))
    back = lambda df: df.withColumnRenamed("query_id", "kind").join(ids, "kind").drop("kind")
    return back(page_), back(totals)


#: The columns that the orders of a page compare, besides the key.
ORDER = ["date_first", "date_last", "last_synced"]


def search_threads(
    threads: DataFrame, terms: DataFrame | None, positions: DataFrame | None, queries: DataFrame,
    limit: int | None = DEFAULT_LIMIT, statistics: DataFrame | None = None, substrings=None,
) -> DataFrame:
    """Composed search: words, filters, order, page, and the exact ``total``.

    Hits meet the thread table once, as keys with the columns that filters and orders
    read; whole thread rows are fetched for the pages alone. Where there is no token
    index, ``substrings`` (a :class:`substrings.Index`) finds the words anywhere instead.
    """
    ordered = swap_reversed(queries)
    if substrings is not None:
        from threadlens.operators.substrings import match as match_substrings

        hits = match_substrings(substrings, ordered)
    else:
        hits = match(terms, positions, ordered, statistics)
    slim = threads.select(*KEY, "has_attachments", "n_messages", "day_min", "day_max", "max_attachment_size", *ORDER)
    kept = materialise(
        apply_filters(hits, slim, ordered).join(ordered.select("query_id", "sort_by"), "query_id")
        .select("query_id", *KEY, *ORDER, "sort_by"), "kept")
    pages = pages_per_query(kept, limit).select("query_id", *KEY, "rank")
    totals = kept.groupBy("query_id").agg(F.count("*").alias("total"))
    blank = ordered.filter(F.size(words(F.coalesce("q", F.lit("")))) == 0)
    if not blank.isEmpty():
        blank_pages, blank_totals = _blank_results(threads, blank, limit)
        pages, totals = pages.unionByName(blank_pages), totals.unionByName(blank_totals)
    return pages.join(totals, "query_id").join(threads, KEY).join(ordered.select("query_id", "sort_by"), "query_id")


def multi_query(
    threads: DataFrame, terms: DataFrame, positions: DataFrame, queries: DataFrame,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Every hit of every query with its thread row; any-word unless told otherwise.

    A blank query has no hits, and there is no limit. The order of a query's
    list is ``(date_last desc, thread_id)``.
    """
    asked = queries.withColumn("search_mode", F.coalesce("search_mode", F.lit("or")))
    return apply_filters(match(terms, positions, asked, statistics), threads, asked)


def _substring_flags(threads: DataFrame, participants: DataFrame, typed: list[str]) -> DataFrame:
    """Keys with one flag per word: does any field contain it (A-Z folded)?"""

    def contains(field: Column, word: str) -> Column:
        return F.contains(ascii_lower(field), ascii_lower(F.lit(word)))

    def listed(tags: str) -> Column:
        quoted = F.transform(
            F.coalesce(tags, F.array()), lambda t: F.concat(F.lit('"'), t, F.lit('"'))
        )
        return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))

    subject, ai, own = F.coalesce("subject", F.lit("")), listed("ai_tags"), listed("user_tags")
    address = F.concat(F.lit('"'), "address", F.lit('"'))
    head = threads.select(*KEY, *[
        (contains(subject, w) | contains(ai, w) | contains(own, w)).alias(f"w{i}")
        for i, w in enumerate(typed)
    ])
    people = participants.select(
        *KEY, *[contains(address, w).alias(f"w{i}") for i, w in enumerate(typed)]
    )
    some = reduce(lambda a, b: a | b, [F.coalesce(f"w{i}", F.lit(False)) for i in range(len(typed))])
    # Rows without any of the words say nothing about their thread.
    return head.unionByName(people).filter(some).groupBy(*KEY).agg(
        *[F.bool_or(f"w{i}").alias(f"w{i}") for i in range(len(typed))]
    )


def search_substring(
    threads: DataFrame, participants: DataFrame, query: str, mode: str = "and"
) -> DataFrame:
    """Keys of threads whose fields contain the words anywhere.

    One scan for a typed query; every character stands for itself.
    """
    typed = query.split()
    if not typed:
        return threads.select(*KEY)
    flags = [F.col(f"w{i}") for i in range(len(typed))]
    hit = flags[0]
    for flag in flags[1:]:
        hit = hit | flag if mode == "or" else hit & flag
    return _substring_flags(threads, participants, typed).filter(hit).select(*KEY)


def precision_report(
    threads: DataFrame, participants: DataFrame, terms: DataFrame, typed: list[str]
) -> DataFrame:
    """Per word: threads found by substring and by token, one scan each."""
    flags = _substring_flags(threads, participants, typed)
    loose = flags.agg(F.array(*[
        F.struct(F.lit(w).alias("word"), F.count_if(f"w{i}").alias("by_substring"))
        for i, w in enumerate(typed)
    ]).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    folded = F.get(tokens(F.col("word")), F.lit(0))
    counts = (
        terms.filter(F.col("token").isin([F.get(tokens(F.lit(w)), F.lit(0)) for w in typed]))
        .groupBy("token")
        .agg(F.count("*").alias("by_token"))
    )
    return loose.join(counts, folded == F.col("token"), "left").select(
        "word", "by_substring", F.coalesce("by_token", F.lit(0).cast("bigint")).alias("by_token")
    )


# Result shapes ----------------------------------------------------------------

def people_of(participants: DataFrame, hits: DataFrame) -> DataFrame:
    """``participants_str`` of the threads on a result page, all addresses in order."""
    keys = hits.select(*KEY).distinct()
    joined = (
        participants.join(keys, KEY, "left_semi").distinct().groupBy(*KEY)
        .agg(F.array_join(F.array_sort(F.collect_list("address")), ", ").alias("participants_str"))
    )
    return keys.join(joined, KEY, "left").select(
        *KEY, F.coalesce("participants_str", F.lit("")).alias("participants_str")
    )


def result_cards(
    hits: DataFrame, participants: DataFrame, fallback: str = "https://mail.example/inbox"
) -> DataFrame:
    """Card columns: sorted tags, participants, link fallback, scan warning."""
    link = F.coalesce(F.nullif(F.col("web_link"), F.lit("")), F.lit(fallback))
    return hits.join(people_of(participants, hits), KEY, "left").withColumns({
        "tags_sorted": F.array_sort("ai_tags"),
        "user_tags_sorted": F.array_sort("user_tags"),
        "link": link,
    })


def previews(hits: DataFrame, participants: DataFrame) -> DataFrame:
    """The seven preview columns of a hit."""
    return hits.join(people_of(participants, hits), KEY, "left").select(
        *[c for c in ("query_id",) if c in hits.columns],
        "thread_id", "subject", "date_first", "date_last",
        F.coalesce("web_link", F.lit("")).alias("web_link"),
        F.col("participants_str").alias("participants_preview"),
        F.col("ai_tags").alias("tags_preview"),
    )
