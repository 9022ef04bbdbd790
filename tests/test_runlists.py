"""Posting lists of character runs: against brute force, and what a search makes of them."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import rows
from test_search import ask, setup, thread
from threadlens.functions.text import ascii_lower
from threadlens.operators import runlists, substrings
from threadlens.schemas import QUERIES
from threadlens.session import scratch


def brute(texts):
    return {(user, key, text[i:i + n]) for user, key, text in texts for n in (1, 2, 3) for i in range(len(text) - n + 1)}


def listed(texts, batch=7):
    schema = pa.schema([("user_id", pa.string()), ("thread_id", pa.string()), ("text", pa.string())])
    table = pa.Table.from_pylist([dict(zip(schema.names, t, strict=True)) for t in texts], schema)
    return [r for b in runlists.lists(table.to_batches(batch)) for r in b.to_pylist()]


@pytest.mark.parametrize("characters, bits, postings", [(4 << 20, 12, 1 << 20), (1, 12, 1 << 20), (30, 1, 3), (4 << 20, 0, 1)])
def test_lists_against_brute_force(monkeypatch, characters, bits, postings):
    for name, value in (("CHARACTERS", characters), ("LIST_BITS", bits), ("POSTINGS", postings)):
        monkeypatch.setattr(runlists, name, value)
    rng = random.Random(3)
    letters = ["a", "b", "\x00", " ", "\n", "é", "🙂", "\U0010ffff", "漢"]
    keys = [(u, k) for u in (None, "u", "v") for k in (None, *(f"t{i}" for i in range(9)))]
    texts = [(*key, "".join(rng.choices(letters, k=rng.randint(0, 12)))) for key in keys for _ in range(rng.randint(0, 4))]
    got = listed(texts)
    pairs = [(r["user_id"], k, r["gram"]) for r in got for k in r["threads"]]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(texts)
    assert all(r["n"] == len(r["threads"]) <= 1 << bits for r in got)
    if characters > 30 and bits == 12:
        assert [r["gram"] for r in got] == sorted(r["gram"] for r in got)


def test_many_characters_and_threads_are_parted():
    # 60,000 different characters take 16 bits each and leave 15 for 40,000 threads.
    points = [p for p in range(1, 70_000) if not 0xD800 <= p < 0xE000]
    texts = [("u", f"t{i:05}", chr(points[i]) + chr(points[i + 20_000])) for i in range(40_000)]
    pairs = {(r["user_id"], k, r["gram"]) for r in listed(texts, 1000) for k in r["threads"]}
    assert pairs == brute(texts)


def test_no_texts():
    assert listed([]) == [] == listed([("u", "t", ""), ("u", "s", "")])


def test_a_build_stores_lists_and_not_rows_of_postings(spark):
    t, p, _, _ = setup(spark, [thread(f"t{i}", ["tag"], "the same words") for i in range(50)])
    built = substrings.build(t, p, scratch(spark, "substrings"), 2)
    assert rows(built.statistics.filter("gram IN ('wor', 'zzz')"), "user_id", "gram", "df") == [("u", "wor", 50)]
    assert built.grams.filter("gram = 'wor'").count() <= 2
    plan = substrings.posting_lists(built.fields, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_words_of_one_query_are_looked_up_by_the_rarest_run(spark):
    threads = [thread(f"t{i}", ["common"], "a b common" + (" needle" if i == 7 else "")) for i in range(30)]
    t, p, _, _ = setup(spark, threads, [("u", "t7", "far@x")])
    built = substrings.build(t, p, scratch(spark, "substrings"), 2)
    queries = spark.createDataFrame([
        ask(spark, "a common needle far", qid=1), ask(spark, "needle common", qid=2), ask(spark, "b nosuch", qid=3),
        ask(spark, "needle far b", "or", qid=4), ask(spark, "needle a", qid=5), ask(spark, "needle a", qid=5)], QUERIES)
    asked = substrings._asked(queries)
    assert {r.query_id for r in asked.filter("several").collect()} == {4}
    # Not one row a thread for the words that all threads hold.
    found = substrings.found_units(built, asked.filter("query_id <> 4"))
    assert {(r.unit, r.thread_id) for r in found.collect()} == {
        ("a common far needle", "t7"), ("common needle", "t7"), ("a needle", "t7")}
    assert found.count() == 3
    hits = substrings.match(built, queries)
    assert rows(hits.filter("query_id <> 4"), "query_id", "thread_id") == [(1, "t7"), (2, "t7"), (5, "t7")]
    assert hits.filter("query_id = 4").count() == 30


def test_letters_are_lowered_as_before(spark):
    texts = ["", None, "ABCxyz [@`{", "É ABC ß İ", "\U0001f642Z", "a\x00Z"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    plain = F.translate("x", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = df.select(ascii_lower(F.col("x")).alias("got"), plain.alias("plain")).collect()
    assert [r.got for r in got] == [r.plain for r in got]


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_candidates_are_kept_if_each_word_is_in_some_text(batch):
    # Two threads of one place, rows in any order; a word does not reach from one text into the next.
    table = [(1, "u", "s", None, "ab cd"), (1, "u", "s", "xab", None), (1, "u", "s", "cdx", None), (1, "u", "s", None, "bc"),
             (1, "u", "t", "bc", None), (1, "u", "t", None, "bc"), (1, "u", "t", None, "ab"), (2, "u", "v", None, "a"),
             (3, "v", "s", None, "é 🙂"), (3, "v", "s", "🙂é", None), (3, "v", "s", None, "x é")]
    schema = pa.schema([("place", pa.int64()), *((c, pa.string()) for c in ("user_id", "thread_id", "text", "unit"))])
    rows_ = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in table], schema)
    got = [tuple(r.values()) for b in runlists.holding(rows_.to_batches(batch)) for r in b.to_pylist()]
    assert got == [("u", "s", "ab cd"), ("u", "t", "bc"), ("v", "s", "é 🙂")]
    assert [b.num_rows for b in runlists.holding([])] == [0]


def test_texts_and_candidates_meet_without_a_join(spark):
    texts = spark.createDataFrame([("u", "s", "x needle"), ("u", "s", "far"), ("u", "t", "needle"), (None, "s", "far needle")],
                                  "user_id string, thread_id string, text string")
    asked = spark.createDataFrame([("u", "s", "far needle"), ("u", "t", "far needle"), (None, "s", "far"), ("u", None, "far")],
                                  "user_id string, thread_id string, unit string")
    got = substrings._checked(texts, asked, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert rows(got) == [("u", "s", "far needle")]
