import random

import pytest

from helpers import rows
from threadlens.functions import text as tx
from threadlens.operators import index, rounds, search
from threadlens.schemas import QUERIES
from pyspark.sql import functions as F

THREAD = ("user_id string, thread_id string, subject string, date_first string, date_last string, "
          "n_messages bigint, day_min string, day_max string, has_attachments boolean, web_link string, "
          "max_attachment_size bigint, ai_tags array<string>, user_tags array<string>, last_synced string")


def thread(i, tags=(), subject="", user="u", own=(), n=1, days=("2020-01-01", "2020-01-01"), att=False, size=None):
    return (user, i, subject, days[0], days[1], n, days[0], days[1], att, "", size, list(tags), list(own), i)


def setup(spark, threads, people=()):
    t = spark.createDataFrame(threads, THREAD)
    p = spark.createDataFrame(list(people), "user_id string, thread_id string, address string")
    return t, p, index.terms(t, p), index.positions(t, p)


def ask(spark, q, mode="and", user="u", qid=1, **f):
    return (user, 1, f.get("round", 1), qid, q, mode, f.get("att"), f.get("multi"), f.get("lo"), f.get("hi"),
            f.get("kb"), f.get("sort"))


def hits(spark, built, *queries):
    _, _, terms, positions = built
    return rows(search.match(terms, positions, spark.createDataFrame(list(queries), QUERIES)),
                "query_id", "thread_id")


@pytest.fixture(scope="module")
def archive(spark):
    return setup(spark, [
        thread("car", ["car", "honda civic"]), thread("card", ["card", "td bank"], "Scar tissue"),
        thread("rev", ["bank td"]), thread("words", [], "and or NEAR not"),
        thread("café", ["café"], "İzmir Straße naïve"), thread("own", [], "", own=["Mine Own"]),
        thread("border", ["x", "td"], "bank"), thread("other", ["car"], user="v"),
    ], [("u", "car", "bob@mail.com"), ("u", "car", "ann@mail.com"), ("u", "card", "bank@zoo.org")])


WORDS = [
    ("car", "and", ["car"]), ("civic", "and", ["car"]), ("car civic", "and", ["car"]),
    ("car card", "and", []), ("car card", "or", ["car", "card"]), ("CAFE", "and", ["café"]),
    ("café", "and", ["café"]), ("izmir", "and", ["café"]), ("strasse", "and", []), ("straße", "and", ["café"]),
    ("naive", "and", ["café"]), ("and or", "and", ["words"]), ("NEAR", "and", ["words"]),
    ('"not"', "and", ["words"]), ("td-bank", "and", ["border", "card"]), ("bank-td", "and", ["rev"]),
    ("*", "and", []), ("* car", "and", []), ("* car", "or", ["car"]), ("", "and", []), ("  ", "or", []),
    ("mine", "and", ["own"]), ("bob@mail.com", "and", ["car"]), ("mail.com/bob", "and", ["car"]),
    ("mail.bob", "and", []), ("ann@mail.com car", "and", ["car"]), ("td-bank nosuch", "or", ["border", "card"]),
    ("tissue-bank", "and", ["card"]),
]


def test_words(spark, archive):
    """All typed queries in one job."""
    queries = [ask(spark, q, mode, qid=i) for i, (q, mode, _) in enumerate(WORDS)]
    got = hits(spark, archive, *queries)
    for i, (q, mode, found) in enumerate(WORDS):
        assert [t for k, t in got if k == i] == found, (q, mode)


def test_tenants_do_not_mix_and_queries_share_a_job(spark, archive):
    got = hits(spark, archive, ask(spark, "car", user="v", qid=7), ask(spark, "bank car", "or", qid=8))
    assert got == [(7, "other"), (8, "border"), (8, "car"), (8, "card"), (8, "rev")]


def test_match_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "dd", "ee"]
    threads = [thread(f"t{i}", [rng.choice(words)], " ".join(rng.choices(words, k=rng.randint(0, 7))))
               for i in range(120)]
    people = [("u", f"t{rng.randint(0, 119)}", f"{rng.choice(words)}@{rng.choice(words)}.{i}") for i in range(60)]
    built = setup(spark, threads, people)
    queries = [ask(spark, " ".join(rng.choice(["", "-"]).join(rng.choices(words, k=rng.randint(1, 3)))
                                   for _ in range(rng.randint(1, 3))), rng.choice(["and", "or"]), qid=q)
               for q in range(40)]

    def cut(text):
        return [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]

    texts = {t[1]: cut(" ".join(t[11] + t[12] + [t[2]] + sorted({a for _, k, a in people if k == t[1]})))
             for t in threads}

    def has(tokens, word):
        w = cut(word)
        return any(tokens[i:i + len(w)] == w for i in range(len(tokens))) if w else False

    expected = sorted(
        ((q[3], k) for q in queries for k, tokens in texts.items()
         if (any if q[5] == "or" else all)(has(tokens, w) for w in q[4].split())), key=str)
    assert hits(spark, built, *queries) == expected


def test_many_literals_take_the_join_path(spark, archive, monkeypatch):
    monkeypatch.setattr(search, "LITERALS", 0)
    monkeypatch.setattr(search, "SMALL", 0)
    assert hits(spark, archive, ask(spark, "td-bank"), ask(spark, "car civic", qid=2)) == [
        (1, "border"), (1, "card"), (2, "car")]


def test_positions_of_many_participants(spark):
    people = [("u", "t", f"{chr(97 + i % 26)}{i:03d}@x") for i in range(300)]
    _, _, _, positions = setup(spark, [thread("t", ["tag"], "one two")], people)
    got = [r["token"] for r in positions.orderBy("pos").collect()]
    expected = ["tag", "one", "two"]
    for a in sorted(p[2] for p in people):
        expected += a.split("@")
    assert got == expected


def test_filters_and_totals(spark):
    built = setup(spark, [
        thread("wide", ["k"], days=("2010-01-01", "2020-01-01"), n=2), thread("big", ["k"], att=True, size=500_000),
        thread("undated", ["k"], days=("", "")), thread("last", ["k"], days=("2021-05-05", "2021-05-05")),
    ])

    def found(**f):
        q = spark.createDataFrame([ask(spark, "k", **f)], QUERIES)
        return sorted(r["thread_id"] for r in search.search_threads(built[0], built[2], built[3], q).collect())

    assert found(lo="2015-01-01", hi="2015-12-31") == ["wide"]
    assert found(lo="2015-12-31", hi="2015-01-01") == ["wide"]
    assert found(hi="2009-01-01") == ["undated"]
    assert found(multi=True) == ["wide"] and found(att=True) == ["big"]
    assert found(kb=100) == ["big"] and found(kb=1000) == [] and len(found(kb=0)) == 4
    assert found(att=False, lo="2021-01-01") == ["last"]
    q = spark.createDataFrame([ask(spark, "k", sort="date_desc"), ask(spark, "", qid=2, sort="odd")], QUERIES)
    page = search.search_threads(built[0], built[2], built[3], q, limit=2)
    assert rows(page, "query_id", "rank", "thread_id", "total") == [
        (1, 1, "last", 4), (1, 2, "big", 4), (2, 1, "wide", 4), (2, 2, "undated", 4)]
    assert search.multi_query(built[0], built[2], built[3], q.withColumn("search_mode", F.lit(None).cast("string"))
                              ).count() == 4


def test_page_plan_limits_before_the_shuffle(spark):
    t = spark.createDataFrame([thread(f"t{i}") for i in range(20)], THREAD).withColumns(
        {"query_id": F.col("n_messages"), "sort_by": F.col("last_synced")})
    plan = search.pages_per_query(t, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "TakeOrderedAndProject" in search.page(t)._jdf.queryExecution().executedPlan().toString()


def test_substring_literals(spark):
    t, p, _, _ = setup(spark, [thread("pct", [], "100% off_now"), thread("no", [], "100 offXnow"),
                               thread("tag", ["a\\b"])], [("u", "no", "Joe_Doe@X.com")])
    one = lambda q, m="and": [r[1] for r in rows(search.search_substring(t, p, q, m))]
    assert one("100%") == ["pct"] and one("f_n") == ["pct"] and one("a\\b") == ["tag"]
    assert one("joe_doe offx") == ["no"] and one("100% a\\b", "or") == ["pct", "tag"]
    assert one('["a') == ["tag"] and sorted(one("")) == ["no", "pct", "tag"]


def test_tokens_and_folding(spark):
    df = spark.range(1).select(
        tx.tokens(F.lit("Éclair, naïve—Ångström 3.5 é Ơ Łódź 北京 foo_bar")).alias("t"),
        tx.fold_subject(F.lit("  “Hi” – It’s\t ok ")).alias("s"),
        tx.date_label(F.lit("2020-01-01T1"), F.lit("2020-01-02T1")).alias("d"),
        tx.date_label(F.lit(""), F.lit("2020-01-02")).alias("e"),
    ).first()
    assert df["t"] == ["eclair", "naive", "angstrom", "3", "5", "e", "o", "łodz", "北京", "foo", "bar"]
    assert df["s"] == "\"hi\" - it's ok" and df["d"] == "2020-01-01 — 2020-01-02" and df["e"] == "2020-01-02"


def test_rounds(spark):
    h = spark.createDataFrame(
        [(1, 1, q, "u", f"t{k}", f"2020-01-{k:02d}") for q, ks in ((1, (1, 2, 3, 4)), (2, (2, 5, 6, 7))) for k in ks]
        + [(1, 2, 3, "u", "t2", "2020-01-02"), (1, 2, 3, "u", "t9", "2020-01-09")],
        "session_id bigint, round bigint, query_id bigint, user_id string, thread_id string, date_last string")
    merged = rounds.merge_round(h)
    assert rows(merged.filter("round = 1"), "query_id", "thread_id")[:5] == [
        (1, "t1"), (1, "t2"), (1, "t3"), (1, "t4"), (2, "t5")]
    top = rounds.top_n(merged)
    assert rows(top.filter("round = 1"), "place", "thread_id", "more") == [
        (1, "t4", 2), (2, "t3", 2), (3, "t2", 2), (4, "t1", 2), (5, "t7", 2)]
    assert rows(rounds.accumulate(merged).filter("thread_id in ('t2', 't9')"), "thread_id", "first_round") == [
        ("t2", 1), ("t9", 2)]
    assert rows(rounds.new_in_round(merged.filter("round = 2"), merged.filter("round = 1")), "thread_id") == [("t9",)]
    q = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True)],
                              "session_id bigint, round bigint, failed boolean")
    t = merged.select("user_id", "thread_id").distinct().withColumns(
        {"subject": F.when(F.col("thread_id") == "t9", "").otherwise(F.col("thread_id")),
         "date_first": F.lit("2019-01-01T")})
    s = rounds.round_summary(merged, q, t)
    assert rows(s, "round", "found", "failed", "kind") == [(1, 7, 0, "list"), (2, 2, 1, "list"), (3, 0, 1, "none")]
    assert s.filter("round = 2").first()["listing"] == "(no subject) | 2019-01-01\nt2 | 2019-01-01"
    assert rows(rounds.round_summary(merged, q, t, 3), "round", "kind")[0] == (1, "count")


def test_match_subjects_against_brute_force(spark):
    rng = random.Random(5)
    base = ["re: quarterly figures for the north region", "lunch", "re: quarterly figures for the south region", "aaaaaaaaaaaaaaaaaa"]
    found = [(1, f"t{i}", (s[rng.randint(0, 9):] + rng.choice(["", "!", " again and again"])).upper(), i)
             for i, s in enumerate(base * 8)] + [(1, "blank", "", 99), (2, "t0", "lunch", 0)]
    cited = [(1, i, rng.choice(base)[rng.randint(0, 6):rng.randint(14, 50)]) for i in range(40)] + [(1, 90, "Re:")]
    got = rounds.match_subjects(
        spark.createDataFrame(cited, "session_id bigint, cite_id bigint, cited string"),
        spark.createDataFrame(found, "session_id bigint, thread_id string, subject string, found_pos bigint"))

    def first(w):
        for s, t, h, _ in found:
            h = h.lower()
            if s != 1 or not h:
                continue
            a, b = sorted((" ".join(h.split()), w), key=len)
            if a == b or (len(a) >= 12 and len(a) < len(b) and a in b):
                return t
        return None

    expected = sorted(((i, first(" ".join(c.lower().split()))) for _, i, c in cited), key=str)
    assert rows(got, "cite_id", "thread_id") == expected


def test_samples_of_a_text_are_samples_of_what_contains_it(spark):
    """Every part of 12 characters or more has a subset of the samples, however the text is cut into chunks."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdé 😀z") for _ in range(700)) + "a" * 90 + "\n tail of it"
    parts = [(1, "whole", text)] + [
        (1, f"{a}-{n}", text[a:a + n]) for a in range(0, len(text) - 12, 29) for n in (12, 13, 64, 77, 300)]
    got = rounds._samples(spark.createDataFrame(parts, "session_id bigint, id string, text string"), "id")
    held = {}
    for _, name, sample in got.collect():
        held.setdefault(name, set()).add(sample)
    assert set(held) == {name for _, name, t in parts if len(t) >= 12}
    assert all(v <= held["whole"] for v in held.values())
    assert len(held["whole"]) < len(text) / 2
