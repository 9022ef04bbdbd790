"""What a sync reads and deals to keep the token index."""

import random

import pytest

from helpers import rows
from test_search import setup, thread
from test_sync import box, message  # noqa: F401
from threadlens.operators import index
from threadlens.streaming import sync


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("many", [0, 2, 5, 100_000])
def test_addresses_are_numbered_in_one_or_two_levels(spark, monkeypatch, many):
    monkeypatch.setattr(index, "MANY", many)
    rng = random.Random(5)
    people = sorted({(u, t, "".join(rng.choices("ab.", k=rng.randint(1, 5))) + "@x") for _ in range(60)
                     for u in "uv" for t in ("s", "t", "r")} - {("u", "r", "a@x")})
    people = [p for k, p in enumerate(people) if p[1] != "r" or k % 9 == 0]
    people += [("u", "s", None), (None, "s", "a@x"), ("u", None, "a@x")]
    t, p, _, _ = setup(spark, [thread("s")], people)
    got = rows(index.positions(t.limit(0), p), "user_id", "thread_id", "pos", "token")
    want = []
    for key in {x[:2] for x in people if None not in x}:
        said = [w for x in sorted(p for p in people if p[:2] == key and p[2]) for w in x[2].replace("@", ".").split(".") if w]
        want += [(*key, n, w) for n, w in enumerate(said)]
    assert got == sorted(want, key=str)


def test_addresses_of_usual_threads_are_not_joined_to_sums(spark):
    t, p, _, _ = setup(spark, [thread("s")], [("u", "s", "b@x"), ("u", "s", "a@x")])
    # The two-level sums stand for threads of very many addresses alone.
    offsets = index._address_offsets(p)
    offsets.collect()
    final = plan(offsets)
    assert "Union" in final.split("Initial Plan")[-1]
    assert rows(offsets, "offset", "tokens") == [(0, ["a", "x"]), (2, ["b", "x"])]


def test_terms_without_an_order_are_the_same_rows(spark):
    t, p, terms, _ = setup(spark, [thread("a", ["x"], "one two one"), thread("a", ["x"], "two"), thread(None, [], "n", user=None)],
                           [("u", "a", "two@x"), ("u", "a", None)])
    assert rows(index.unordered_terms(t, p), "user_id", "thread_id", "token") == rows(terms, "user_id", "thread_id", "token")
    assert "Window" not in plan(index.unordered_terms(t, p))


@pytest.mark.parametrize("few", [0, 100_000])
def test_postings_are_dealt_by_thread_alone(box, spark, monkeypatch, few):  # noqa: F811
    monkeypatch.setattr(sync, "FEW_KEYS", few)
    box.messages = [message("a", "t1", seq=1, subject="red", from_addr="p@x"), message("b", "t2", seq=2, subject="blue")]
    box.report(("t1", None), ("t2", None))
    box.run("first", index=True)
    box.messages = [message("a", "t1", seq=1, subject="red", from_addr="p@x"),
                    message("c", "t1", seq=3, date="2099-01-01", subject="red", from_addr="q@y")]
    box.report(("t1", None), (None, "b"))
    box.run("second", index=True)
    left = sync.postings(spark, box.root, "terms")
    threads, people = sync.current(spark, box.root), sync.current_child(spark, box.root, "participants")
    assert rows(left, "thread_id", "token") == rows(index.terms(threads, people), "thread_id", "token")
    assert {r.token for r in left.collect()} >= {"red", "p", "q"} and "blue" not in {r.token for r in left.collect()}
    assert rows(sync.term_statistics(spark, box.root)) == rows(index.statistics(left))
    for read in (left, people):
        dealt = [line for line in plan(read).split("Initial Plan")[0].splitlines() if "hashpartitioning" in line]
        assert dealt and not any("turn" in line or "batch" in line for line in dealt)
