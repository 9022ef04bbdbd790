"""Resharding and web archives: exact round trips."""

import io
import itertools
import random
import zlib

import pytest
from check import compare, database
from data import DOCS, docs, prose
from pyspark.sql import functions as F

from threadlens.llm import reshard, rules, warc


def test_flow_is_the_cheapest():
    r = random.Random(5)
    for _ in range(40):
        n, m = r.randint(1, 3), r.randint(1, 3)
        supply = [r.randint(0, 4) for _ in range(n)]
        capacity = [r.randint(0, 5) for _ in range(m)]
        cost = {(i, j): r.randint(0, 4) for i in range(n) for j in range(m)}
        if sum(supply) > sum(capacity):
            with pytest.raises(ValueError):
                reshard.cheapest_flow(supply, capacity, lambda i, j: cost[i, j])
            continue
        flow = reshard.cheapest_flow(supply, capacity, lambda i, j: cost[i, j])
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(m))
        units = [i for i in range(n) for _ in range(supply[i])]
        best = min((sum(cost[i, j] for i, j in zip(units, to, strict=True)) for to in itertools.product(range(m), repeat=len(units))
                    if all(to.count(j) <= capacity[j] for j in range(m))), default=0)
        assert sum(flow[i][j] * cost[i, j] for i in range(n) for j in range(m)) == best


def old_shard():
    return F.pmod(F.xxhash64("text"), F.lit(3))


def test_equal_texts_stay_together_beside_a_large_one(spark):
    """A block is split by text; only a text that is too large itself is torn."""
    rows = [(2 * k + c, f"pair {k}") for k in range(500) for c in (0, 1)] + [(5000, "y" * 30_000)]
    out, plan = reshard.resharded(docs(spark, rows), F.lit(0), 8)
    found = out.select("text", "shard").collect()
    shards = {}
    for r in found:
        shards.setdefault(r.text, set()).add(r.shard)
    assert plan.parts and len(found) == len(rows) and all(len(s) == 1 for s in shards.values())
    copies = rows[:200] + [(10_000 + k, "z" * 200) for k in range(400)]
    out, plan = reshard.resharded(docs(spark, copies), F.lit(0), 8)
    shards = {}
    for r in out.select("text", "shard").collect():
        shards.setdefault(r.text, set()).add(r.shard)
    assert plan.torn and len(shards.pop("z" * 200)) > 1 and all(len(s) == 1 for s in shards.values())
    sizes = out.groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert max(r.b for r in sizes) < 1.5 * min(r.b for r in sizes)


def test_reshard_round_trip(spark):
    rows = DOCS + [(100 + k, prose(20 + k % 30, k)) for k in range(400)]
    out, plan = reshard.resharded(docs(spark, rows), old_shard(), 4)
    have = out.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in have) == sorted((str(d), str(t)) for d, t in rows)
    assert all(r.size == len((r.text or "").encode()) + 1 for r in have)
    for s in range(4):
        assert sorted(r.slot for r in have if r.shard == s) == list(range(sum(r.shard == s for r in have)))
    homes = {}
    for r in have:
        assert homes.setdefault(r.text, r.shard) == r.shard or r.text == DOCS[3][1]
    assert plan.affected and plan.moved_bytes > 0


def test_a_hot_group_is_split_and_sizes_stay_near(spark):
    rows = [(k, "the same text again and again") for k in range(3000)] + [(5000 + k, prose(8, k)) for k in range(1500)]
    out, _ = reshard.resharded(docs(spark, rows), old_shard(), 4)
    sizes = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 4 and max(sizes) < 1.15 * sum(sizes) / 4


def test_nothing_moves_without_need(spark):
    out, plan = reshard.resharded(docs(spark, [(1, "a"), (2, "b")]), F.col("doc_id") - 1, 2)
    assert plan.moved_bytes == 0 and plan.affected == [] and {r.doc_id: r.shard for r in out.collect()} == {1: 0, 2: 1}
    empty, _ = reshard.resharded(docs(spark, []), old_shard(), 2)
    assert empty.count() == 0


def test_loser_tree():
    r = random.Random(1)
    for k in range(0, 12):
        runs = [sorted(r.randint(0, 30) for _ in range(r.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_urls_and_ids():
    assert warc.url_key("https://www.Ex-ample.org:80/a/B?x=1#top") == "org,ex-ample)/a/B?x=1"
    assert warc.url_key("http://u@m.a.b") == "b,a,m)/" and warc.url_key(None) == "" and warc.url_key("odd one#x") == "odd one"
    for i in (0, 1, -1, 2**63 - 1, -2**63, 123456789, None):
        assert warc.page_id_of(warc.record_urn(i)) == i


def test_record_round_trip():
    payload = "é\r\n\r\nWARC/1.1\r\n".encode()
    whole = warc.parsed(warc.record(3, "http://a.b/ c\n", 1700000000, payload, None, False))
    assert whole["payload"] == payload and whole["page_id"] == 3 and whole["url"] == "http://a.b/%20c%0A"
    again = warc.parsed(warc.record(4, None, 0, payload, 3, True))
    assert (again["record_type"], again["refers_to"], again["payload_bytes"], again["payload"]) == ("revisit", 3, len(payload), None)
    broken = warc.record(3, "u", 0, payload, None, False, "A" * 32)
    with pytest.raises(ValueError):
        warc.parsed(broken)
    assert zlib.decompress(warc.record(3, "u", 0, b"", None, False), 31).endswith(b"\r\n\r\n") and io.BytesIO


PAGES = [
    (1, "http://b.org/x", "same"), (2, "http://a.org/", "same"), (3, None, None), (4, "http://a.org/", ""), (5, "http://a.org/", "z" * 300_000),
    (6, "odd", "é\n\0"), (6, "odd", "é\n\0"), (None, "http://c.org", "same"), (None, "http://c.org", "alone"), (7, "http://a.org/", "same"),
]


@pytest.mark.parametrize("file_bytes", [1, 1 << 20])
def test_archives(spark, file_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("offset", F.lit("clash")).repartition(3)
    runs = warc.written(pages, F.lit(100) + F.coalesce("page_id", F.lit(0)), file_bytes=file_bytes)
    have = warc.read(warc.merged(runs), payloads=True).orderBy("position").collect()
    assert [r.position for r in have] == list(range(len(PAGES)))
    keys = [(r.url_key, r.page_id is not None, r.page_id or 0) for r in have]
    assert keys == sorted(keys)
    types = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in have)
    assert types == sorted([
        ("1", 4, "revisit", "7"), ("2", 4, "revisit", "7"), ("7", 4, "response", "None"), ("None", 4, "revisit", "7"),
        ("3", 0, "revisit", "4"), ("4", 0, "response", "None"), ("5", 300_000, "response", "None"), ("None", 5, "response", "None"),
        ("6", 4, "response", "None"), ("6", 4, "response", "None")])
    assert all(r.payload_digest == warc.payload_digest(bytes(r.payload)) for r in have if r.payload is not None)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.merged(warc.written(pages, F.lit(0)))).count() == 0


@pytest.mark.parametrize("module, name", [(rules, "op6_quality_rules"), (warc, "op2_warc")])
def test_sql(spark, module, name):
    sf = "/root/testdata/sf0.001"
    n, problem = compare(spark, database(sf), module.QUERIES[name], module.SQL[name], sf)
    assert problem is None and n > 0, problem
