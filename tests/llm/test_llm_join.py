"""The n-gram Jaccard join and its components against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from data import BASE, DOCS, docs, prose

from threadlens.llm import ngram_join
from threadlens.llm.components import components


def brute(rows):
    """(id, size, component, links) of each row: all sets compared through an inverted index."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[find(i)], default=None), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in ngram_join.linked(docs(spark, rows)).collect()), key=str)


def test_edges(spark):
    assert got(spark, DOCS) == brute(DOCS)


def test_empty(spark):
    assert got(spark, []) == []


def near(seed, n, copies):
    r, out = random.Random(seed), []
    for _ in range(copies):
        words = prose(n, seed).split()
        for _ in range(r.randint(0, max(1, n // 40))):
            words[r.randrange(len(words))] = prose(1, r.random())
        out.append(" ".join(words))
    return out


def test_near_copies_and_shared_passages(spark):
    passage = prose(30, 77)
    texts = [t for s, (n, c) in enumerate([(50, 6), (200, 9), (8, 5), (4, 4), (400, 3)]) for t in near(s, n, c)]
    texts += [prose(40, 100 + k) + " " + passage for k in range(12)] + near(9, 120, 2) * 3
    rows = list(enumerate(texts))
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("frequent, block", [(2, 3), (4, 8)])
def test_large_clusters_in_blocks(spark, monkeypatch, frequent, block):
    """Frequent shingles and blocks of a few sets: the same links."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", 16)
    texts = near(1, 150, 40) + near(2, 60, 15) + [BASE] * 3
    rows = list(enumerate(texts))
    assert got(spark, rows) == brute(rows)


def test_a_group_above_a_block_is_dealt_out(spark, monkeypatch):
    """One prefix and size for all, alone in its cluster or not: the same links, and no task holds the group."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    most, tasks = [], ngram_join._tasks

    def watched(*args):
        out = tasks(*args)
        most.append(max(r["count"] for r in out.groupBy("pack", "item").count().collect()))
        return out

    monkeypatch.setattr(ngram_join, "_tasks", watched)
    passage = prose(94, 5)
    alike = [passage + " " + prose(10, 1000 + k) for k in range(150)]
    for texts in (alike, alike + [passage + " " + prose(5, 2000 + k) for k in range(20)]):
        rows = list(enumerate(texts))
        assert got(spark, rows) == brute(rows)
    assert max(most) <= 4 * 16


def test_threshold_is_exact():
    """8 of 10 shingles in common link, 7 of 9 do not."""
    a = np.arange(9, dtype=np.uint64)
    for other, expected in ((np.arange(1, 10, dtype=np.uint64), True), (np.arange(2, 9, dtype=np.uint64), False)):
        size = np.array([9, len(other)])
        yes = np.ones(2, bool)
        i, _ = ngram_join.joined_pairs(size, np.array([1, 2]), [a, other], [a, other], yes, yes)
        both = len(set(a) & set(other))
        assert (len(i) == 1) == (100 * both >= 80 * (9 + len(other) - both)) == expected


def test_products():
    r = np.random.default_rng(1)
    lists = [np.unique(r.integers(0, 60, 25)).astype(np.uint64) for _ in range(9)]
    want = [[len(set(a) & set(b)) for b in lists] for a in lists]
    assert ngram_join._products(lists).tolist() == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (200, 200)]
    random.Random(3).shuffle(chain)
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 200}
