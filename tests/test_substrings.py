"""Substring searches over the index of character runs, and term statistics."""

import random

import pytest

from helpers import rows
from threadlens.operators import index, search, substrings
from threadlens.schemas import QUERIES
from threadlens.session import scratch
from test_search import ask, setup, thread

LETTERS = ["a", "B", "ab", "%", "_", "\\", "é", "🙂", "[", '"', ".", "x1", "Z"]


@pytest.fixture(scope="module")
def archive(spark):
    rng = random.Random(11)
    piece = lambda n: "".join(rng.choices(LETTERS, k=n))
    threads = [thread(f"t{i}", [piece(2)] if i % 3 else [], " ".join(piece(rng.randint(0, 6)) for _ in range(i % 5)),
                      user="u" if i % 4 else "v", own=[piece(3), "Own"] if i % 7 == 0 else ()) for i in range(90)]
    threads += [thread("null", (), None), thread("long", ["ab"], "x1 " * 5000 + "🙂needle%")]
    people = [(t[0], t[1], f"{piece(2)}@{piece(3)}") for t in rng.choices(threads, k=60)]
    return threads, people


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts(threads, people):
    listed = lambda tags: "[" + ", ".join(f'"{t}"' for t in tags) + "]"
    out = {(t[0], t[1]): [lower(t[2] or ""), lower(listed(t[11])), lower(listed(t[12]))] for t in threads}
    for user, key, address in people:
        out[user, key].append(lower(f'"{address}"'))
    return out


def expected(threads, people, queries):
    out = []
    for q in queries:
        words = [lower(w) for w in (q[4] or "").split()]
        some = any if q[5] == "or" else all
        out += [(q[3], user, key) for (user, key), fields in texts(threads, people).items()
                if words and user == q[0] and some(any(w in f for f in fields) for w in words)]
    return sorted(out, key=str)


def asked(spark, seed=4, n=70):
    rng = random.Random(seed)
    typed = [" ".join("".join(rng.choices(LETTERS, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    typed += ["", "  ", None, "needle%", "🙂needle", "🙂N", "x1 x1", '["', '"]', "own", "nosuchrun", "a nosuchrun", "\\", "%%"]
    return [ask(spark, q, rng.choice(["and", "or", None]), user=rng.choice("uuv"), qid=i) for i, q in enumerate(typed)]


@pytest.mark.parametrize("literals, small", [(500, 100_000), (3, 100_000), (0, 0)])
def test_against_every_text(spark, archive, monkeypatch, literals, small):
    monkeypatch.setattr(substrings, "LITERALS", literals)
    monkeypatch.setattr(substrings, "SMALL", small)
    t, p, _, _ = setup(spark, *archive)
    built = substrings.build(t, p, scratch(spark, "substrings"))
    queries = asked(spark)
    found = substrings.match(built, spark.createDataFrame(queries, QUERIES))
    assert rows(found, "query_id", "user_id", "thread_id") == expected(*archive, queries)


def test_runs_keep_characters_whole(spark):
    df = spark.createDataFrame([("ab🙂é",), ("a",), ("",), ("aaaa",)], "t string").select(substrings.runs("t").alias("r"))
    assert [r[0] for r in df.collect()] == [
        ["a", "b", "🙂", "é", "ab", "b🙂", "🙂é", "ab🙂", "b🙂é"], ["a"], [], ["a", "aa", "aaa"]]


def test_empty_archive(spark):
    t, p, _, _ = setup(spark, [thread("x")])
    built = substrings.build(t.limit(0), p, scratch(spark, "substrings"))
    assert substrings.match(built, spark.createDataFrame([ask(spark, "a")], QUERIES)).count() == 0


def test_fallback_of_the_composed_search(spark, archive):
    t, p, _, _ = setup(spark, *archive)
    built = substrings.build(t, p, scratch(spark, "substrings"))
    queries = [ask(spark, "ab", qid=1, sort="date_desc"), ask(spark, "%", qid=2), ask(spark, " ", qid=3), ask(spark, "", qid=4)]
    found = search.search_threads(t, None, None, spark.createDataFrame(queries, QUERIES), 5, substrings=built)
    totals = {r.query_id: r.total for r in found.collect()}
    want = expected(*archive, queries)
    everyone = sum(x[0] == "u" for x in archive[0])
    assert totals == {q: sum(w[0] == q for w in want) for q in (1, 2)} | {3: everyone, 4: everyone}
    assert found.filter("query_id = 3").count() == 5


def test_deltas_follow_inserts_updates_and_deletions(spark):
    _, _, before, _ = setup(spark, [thread("a", ["one two"]), thread("b", ["two"]), thread("c", ["two"], user="v")])
    _, _, after, _ = setup(spark, [thread("a", ["two three"]), thread("c", ["two"], user="v")])
    nothing = before.limit(0)
    log = index.deltas(nothing, before).unionByName(index.deltas(before, after))
    assert rows(index.summed(log)) == rows(index.statistics(after)) == [("u", "three", 1), ("u", "two", 1), ("v", "two", 1)]
    gone = log.unionByName(index.deltas(after, nothing))
    assert index.summed(gone).count() == 0


def test_statistics_give_the_same_hits_and_disjoint_reads(spark, tmp_path):
    t, p, terms, positions = setup(spark, [
        thread(f"t{i}", ["common"] + (["rare"] if i == 3 else []), f"n{i % 4}") for i in range(40)])
    index.write(terms, f"{tmp_path}/terms")
    terms = spark.read.parquet(f"{tmp_path}/terms")
    counts = index.statistics(terms)
    queries = spark.createDataFrame([
        ask(spark, "common rare", qid=1), ask(spark, "n1 common", qid=2), ask(spark, "n2 nosuch", qid=3),
        ask(spark, "rare n3", "or", qid=4)], QUERIES)
    plain = rows(search.match(terms, positions, queries), "query_id", "thread_id")
    assert rows(search.match(terms, positions, queries, counts), "query_id", "thread_id") == plain
    assert {q for q, _ in plain} == {1, 2, 4}
    ix = search._Index(terms, positions, search._units(queries), counts)
    plan = search._units_with_all_tokens(ix)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/terms" in line]
    # Rare anchors in one read, the common token in the other; no read for counting.
    assert len(scans) == 3 - ("Union" not in plan)  # single words, anchors of the rest, the rest
    assert sum("common" in line for line in scans) == 1
