"""The token index as two ordinary tables.

``terms`` holds distinct ``(user_id, thread_id, token)`` rows and answers
word searches; ``positions`` holds every occurrence and is read only for
phrases. Positions run over AI tags, own tags, subject and the sorted
participants, in that order; they are negative up to the end of the subject
and count from zero through the participants, so either part is numbered
without knowing the other.

Texts are dealt by thread as they are, a shuffle of the size of the texts (lists of
tokens take twice that); they are cut, and postings put in order of their tokens, after
it. So every file of the index holds the postings of some threads, ordered by token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threadlens.functions.text import tokens
from threadlens.schemas import KEY
from threadlens.session import by_key, rows_of

POSTING = ["user_id", "thread_id", "token"]


def _head(threads: DataFrame) -> DataFrame:
    return threads.select(*KEY, F.concat_ws(" ", "ai_tags", "user_tags", "subject").alias("text"))


def terms(threads: DataFrame, participants: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct tokens of each thread, dealt by thread over ``parts`` partitions and ordered by token."""
    return ordered_once(_token_rows(threads, participants, parts), "token")


def unordered_terms(threads: DataFrame, participants: DataFrame) -> DataFrame:
    """The rows of :func:`terms` for places that put them in an order of their own."""
    return _token_rows(threads, participants, None).distinct()


def _token_rows(threads: DataFrame, participants: DataFrame, parts: int | None) -> DataFrame:
    """The tokens of each text, dealt by thread."""
    texts = _head(threads).unionByName(participants.select(*KEY, F.col("address").alias("text")))
    cut = by_key(texts, KEY, parts).select(*KEY, F.array_distinct(tokens(F.col("text"))).alias("tokens"))
    return rows_of(cut, *KEY, name="token", lists="tokens")


def ordered_once(postings: DataFrame, name: str) -> DataFrame:
    """Distinct ``(user_id, thread_id, name)`` of postings dealt by thread, in order of ``name``.

    Rows have to be in this order where they are stored, so the same sort finds the equal ones.
    """
    equal = Window.partitionBy(name, *KEY).orderBy(name)
    return postings.withColumn("nth", F.row_number().over(equal)).filter("nth = 1").drop("nth")


#: Addresses of a thread that one task may put in order.
MANY = 100_000


def _address_offsets(participants: DataFrame) -> DataFrame:
    """Tokens of the addresses sorted before each address of the same thread.

    The few threads with very many addresses are summed up in two levels, so these are
    never sorted by one task.
    """
    people = participants.filter(" AND ".join(f"{c} IS NOT NULL" for c in (*KEY, "address"))).select(*KEY, "address")
    large = F.broadcast(people.groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") > MANY).select(*KEY))
    before = Window.partitionBy(*KEY).orderBy("address").rowsBetween(Window.unboundedPreceding, -1)
    usual = _counted(people.join(large, KEY, "left_anti")).withColumn(
        "offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return usual.select(*KEY, "tokens", "offset").unionByName(
        _two_levels(_counted(people.join(large, KEY, "left_semi"))))


def _counted(people: DataFrame) -> DataFrame:
    return people.withColumn("tokens", tokens(F.col("address"))).withColumn("n", F.size("tokens").cast("bigint"))


def _two_levels(people: DataFrame) -> DataFrame:
    """The offsets within ``(thread, first letters)`` and over the few letter groups of a thread."""
    people = people.withColumn("lead", F.substring("address", 1, 3))
    in_lead = (
        Window.partitionBy(*KEY, "lead").orderBy("address")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    over_leads = Window.partitionBy(*KEY).orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    lead_offset = (
        people.groupBy(*KEY, "lead").agg(F.sum("n").alias("n"))
        .select(*KEY, "lead", F.coalesce(F.sum("n").over(over_leads), F.lit(0)).alias("lead_from"))
    )
    return (
        people.withColumn("in_lead", F.coalesce(F.sum("n").over(in_lead), F.lit(0)))
        .join(lead_offset, [*KEY, "lead"])
        .select(*KEY, "tokens", (F.col("lead_from") + F.col("in_lead")).alias("offset"))
    )


def positions(threads: DataFrame, participants: DataFrame, parts: int | None = None) -> DataFrame:
    """Every token occurrence with its place in the thread's indexed text."""
    # Not a plain posexplode, for the reason that rows_of names.
    head = by_key(_head(threads), KEY, parts).select(*KEY, tokens(F.col("text")).alias("tokens")).select(
        *KEY, F.size("tokens").alias("n"), F.posexplode_outer("tokens").alias("i", "token")
    ).filter(F.col("token").isNotNull()).select(*KEY, (F.col("i") - F.col("n")).cast("bigint").alias("pos"), "token")
    people = (
        _address_offsets(participants)
        .select(*KEY, "offset", F.posexplode("tokens").alias("i", "token"))
        .select(*KEY, (F.col("offset") + F.col("i")).cast("bigint").alias("pos"), "token")
    )
    return head.unionByName(people)


def statistics(terms: DataFrame) -> DataFrame:
    """(user_id, token, df): in how many threads of a tenant a token occurs."""
    return terms.groupBy("user_id", "token").agg(F.count("*").alias("df"))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(user_id, token, d): what replacing the postings ``before`` by ``after`` does to the statistics."""
    signed = before.select("user_id", "token", F.lit(-1).cast("bigint").alias("d")).unionByName(
        after.select("user_id", "token", F.lit(1).cast("bigint").alias("d")))
    return signed.groupBy("user_id", "token").agg(F.sum("d").alias("d")).filter("d <> 0")


def summed(log: DataFrame) -> DataFrame:
    """The statistics that a log of deltas adds up to; tokens that are gone have no row."""
    return log.groupBy("user_id", "token").agg(F.sum("d").alias("df")).filter("df > 0")


def refresh(
    index: DataFrame, threads: DataFrame, participants: DataFrame, changed: DataFrame,
    build=terms,
) -> DataFrame:
    """Index rows after the threads in ``changed`` were inserted, updated or deleted.

    Only changed threads are tokenised again; deleted ones just lose their rows.
    """
    keys = changed.select(*KEY).distinct()
    kept = index.join(keys, KEY, "left_anti")
    fresh = build(threads.join(keys, KEY, "left_semi"), participants.join(keys, KEY, "left_semi"))
    return kept.unionByName(fresh)


def write_statistics(counts: DataFrame, path: str) -> None:
    """Store the statistics ordered by token, as the index is."""
    counts.repartitionByRange("token", "user_id").sortWithinPartitions("token", "user_id").write.option(
        "parquet.bloom.filter.enabled#token", "true").parquet(path)


def write(index: DataFrame, path: str) -> None:
    """Store each partition of the index ordered by token, so a search reads few pages of a file."""
    index.sortWithinPartitions("token").write.option(
        "parquet.bloom.filter.enabled#token", "true"
    ).parquet(path)
