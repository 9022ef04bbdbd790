"""Substring searches for all tenants, over an index of short character runs.

Every field of a thread (subject, both tag lists as they print, each address in
quotes; A-Z lowered) is a text of its own. ``grams`` lists, for each distinct run of
one, two and three characters, the threads whose texts hold it. A word of up to three
characters is such a run, so its postings are the answer. Longer words, and several that
must all occur, are looked up by the rarest of their runs, and the texts of those
candidates are compared with the words themselves. Every character stands for itself:
nothing is a wildcard.

``statistics`` (how many threads of a tenant hold a run) picks the rarest run without
reading postings.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from threadlens.functions.text import ascii_lower, words
from threadlens.operators import runlists
from threadlens.schemas import KEY
from threadlens.session import by_key, materialise, parts_of

# Bounds of this library: runs pushed down as literals, rows broadcast
LITERALS = 500
SMALL = 100_000

LONGEST = 3

# Sent along with the tasks, whose workers need not find this library.
cloudpickle.register_pickle_by_value(runlists)


class Index(NamedTuple):
    """The three tables a substring search reads."""

    fields: DataFrame
    grams: DataFrame
    statistics: DataFrame


def fields(threads: DataFrame, participants: DataFrame) -> DataFrame:
    """(user_id, thread_id, text): the searched texts of each thread, A-Z lowered."""

    def listed(tags: str) -> Column:
        quoted = F.transform(F.coalesce(tags, F.array()), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
        return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))

    own = threads.select(*KEY, F.explode(F.array(
        F.coalesce("subject", F.lit("")), listed("ai_tags"), listed("user_tags"))).alias("text"))
    people = participants.select(*KEY, F.concat(F.lit('"'), "address", F.lit('"')).alias("text"))
    return own.unionByName(people).filter(F.length("text") > 0).select(*KEY, ascii_lower(F.col("text")).alias("text"))


def runs(text: Column, lengths: range = range(1, LONGEST + 1)) -> Column:
    """The distinct runs of so many characters in ``text``."""
    def of(n: int) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))

    return F.concat(*[of(n) for n in lengths])


def posting_lists(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """(user_id, gram, n, threads): the threads that hold a run, some of them a row and each in one row only.

    Texts are dealt by thread; each task lists the runs of its threads, in order of the runs.
    """
    dealt = by_key(texts, KEY, parts).sortWithinPartitions(*KEY).select(*KEY, "text")
    return dealt.mapInArrow(runlists.lists, runlists.SCHEMA)


def opened(lists: DataFrame) -> DataFrame:
    """One row for each thread of posting lists, in place of ``n`` and ``threads``."""
    rest = [c for c in lists.columns if c not in ("n", "threads")]
    # Not a plain explode, for the reason that rows_of names; ids may be null.
    return lists.select(*rest, F.explode_outer("threads").alias("thread_id"))


def grams(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct (user_id, thread_id, gram) of texts."""
    return opened(posting_lists(texts, parts)).select(*KEY, "gram")


def statistics(lists: DataFrame) -> DataFrame:
    """(user_id, gram, df): threads of a tenant that hold a run."""
    return lists.groupBy("user_id", "gram").agg(F.sum("n").alias("df"))


def build(threads: DataFrame, participants: DataFrame, path: str, parts: int | None = None) -> Index:
    """Write the three tables below ``path``, ordered for look-ups, and read them back."""
    texts = fields(threads, participants)
    texts.write.option("compression", "zstd").parquet(f"{path}/fields")
    spark = threads.sparkSession
    posting_lists(spark.read.parquet(f"{path}/fields"), parts).write.option(
        "parquet.bloom.filter.enabled#gram", "true").option("compression", "zstd").parquet(f"{path}/grams")
    statistics(spark.read.parquet(f"{path}/grams")).repartitionByRange("gram", "user_id").sortWithinPartitions(
        "gram", "user_id").write.parquet(f"{path}/statistics")
    return read(spark, path)


def read(spark, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in Index._fields])


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, user_id, unit, several) of the word sets of which a query needs one.

    All words of a query are one unit, in any-word mode each word is one of ``several``. A unit
    is its words joined by blanks, of which words have none.
    """
    typed = queries.filter("query_id IS NOT NULL AND user_id IS NOT NULL").select(
        "query_id", "user_id", F.coalesce("search_mode", F.lit("and")).alias("mode"),
        F.explode(F.transform(words(F.coalesce("q", F.lit(""))), ascii_lower)).alias("word"))
    # One query may come in several rows, which count together.
    whole = typed.groupBy("query_id", "user_id", "mode").agg(F.array_sort(F.collect_set("word")).alias("words"))
    any_word = F.col("mode") == "or"
    units = F.when(any_word, F.col("words")).otherwise(F.array(F.array_join("words", " ")))
    return whole.select(
        "query_id", "user_id", F.explode(units).alias("unit"), (any_word & (F.size("words") > 1)).alias("several"))


def found_units(index: Index, asked: DataFrame) -> DataFrame:
    """(user_id, unit, thread_id) of the distinct units asked, within their tenant.

    A unit is looked up by the rarest run of all its words; the words that this does not
    answer are looked for in the texts of those threads.
    """
    wanted = asked.select("user_id", "unit").distinct()
    few = wanted.limit(LITERALS + 1).collect()
    small = len(few) <= LITERALS
    if small:
        wanted = asked.sparkSession.createDataFrame(few, wanted.schema)
    else:
        wanted = materialise(wanted, "units")
        small = wanted.count() <= SMALL
    hint = F.broadcast if small else lambda df: df
    looked = wanted.select("user_id", "unit", F.explode(F.split("unit", " ")).alias("word")).select(
        "user_id", "unit", F.explode(
            F.when(F.length("word") > LONGEST, runs(F.col("word"), range(LONGEST, LONGEST + 1)))
            .otherwise(F.array("word"))).alias("gram"))
    postings, counts, texts = index.grams, index.statistics, index.fields
    if len(few) <= LITERALS:
        literal = looked.select("gram").distinct().limit(LITERALS + 1).collect()
        tenants = F.col("user_id").isin(sorted({r["user_id"] for r in few}))
        postings, counts, texts = postings.filter(tenants), counts.filter(tenants), texts.filter(tenants)
        if len(literal) <= LITERALS:
            these = F.col("gram").isin(sorted(r["gram"] for r in literal))
            postings, counts = postings.filter(these), counts.filter(these)
    # A run that no thread of the tenant holds rules the unit out.
    anchors = (
        looked.join(counts, ["user_id", "gram"], "left").groupBy("user_id", "unit")
        .agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.bool_or(F.col("df").isNull()).alias("missing"))
        .filter(~F.col("missing")).drop("missing")
    )
    anchors = materialise(anchors.select(
        "*", F.array_except(F.split("unit", " "), F.array("gram")).alias("open")), "anchors")

    def candidates(some: DataFrame) -> DataFrame:
        return opened(postings.join(hint(some), ["user_id", "gram"]))

    known = candidates(anchors.filter(F.size("open") == 0)).select(*KEY, "unit")
    unsure = candidates(anchors.filter(F.size("open") > 0)).select(*KEY, "unit")
    return known.unionByName(_checked(texts, unsure, parts_of(index.fields)))


def _checked(texts: DataFrame, candidates: DataFrame, parts: int) -> DataFrame:
    """The candidates of which each word is in some text of their thread.

    Both are dealt by thread as one table and put in order of a number, which is cheaper than
    a join on the keys.
    """
    rows = texts.select(*KEY, "text", F.lit(None).cast("string").alias("unit")).unionByName(
        candidates.select(*KEY, F.lit(None).cast("string").alias("text"), "unit"))
    dealt = by_key(rows.filter("user_id IS NOT NULL AND thread_id IS NOT NULL"), KEY, parts)
    return dealt.select(F.xxhash64(*KEY).alias("place"), *KEY, "text", "unit").sortWithinPartitions("place").mapInArrow(
        runlists.holding, runlists.HELD)


def match(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, user_id, thread_id) of all hits; queries without words have none.

    ``queries`` has ``query_id``, ``user_id``, ``q`` and ``search_mode``. Units that
    several queries ask are looked up once.
    """
    asked = materialise(_asked(queries), "asked")
    found = materialise(found_units(index, asked), "found")
    hits = asked.join(found, ["user_id", "unit"])
    # Only a query of several units can meet a thread twice.
    once = hits.filter(~F.col("several")).select("query_id", *KEY)
    return once.unionByName(hits.filter("several").select("query_id", *KEY).distinct())
