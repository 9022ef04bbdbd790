import random

import pytest

from pyspark.sql import functions as F

from helpers import rows
from threadlens.functions import tags as tg, values
from threadlens.operators import tagging


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def tags_of(spark, reply, n):
    reply = F.lit(reply) if reply is not None else F.lit(None).cast("string")
    return [(list(e["tags"]), e["truncated"]) for e in one(spark, tg.parse_tags(reply, F.lit(n)))]


def test_clean_tags(spark):
    c = lambda *t: one(spark, tg.clean_tags(F.array(*[F.lit(x) for x in t])))
    assert c(" Car ", "car", "", " ", "Loan\n", "CAR") == ["car", "loan"]
    assert len(c(*[f"t{i}" for i in range(200)])) == 60
    assert c(*["same"] * 500, *[f"t{i}" for i in range(10)])[-1] == "t9"


@pytest.mark.parametrize("reply, n, expected", [
    ('[["a","B "],["c"]]', 2, [(["a", "b"], False), (["c"], False)]),
    ('```json\n[["a"]]\n```', 1, [(["a"], False)]),
    ('[["a"],["b","c"],["d', 3, [(["a"], True and False), (["b", "c"], False), ([], True)]),
    ('[["a"]]', 2, [(["a"], False), ([], True)]),
    ('[["a"],["b"]]', 1, [(["a"], False)]),
    ("no json", 2, [([], True), ([], True)]),
    (None, 2, [([], True), ([], True)]),
    ("[[2016, true, \"x\"]]", 1, [(["2016", "true", "x"], False)]),
    ('[[],["a"]]', 2, [([], False), (["a"], False)]),
])
def test_parse_tags(spark, reply, n, expected):
    assert tags_of(spark, reply, n) == expected


def test_parse_reply(spark):
    v = lambda s, f: one(spark, F.try_variant_get(tg.parse_reply(F.lit(s)), f"$.{f}", "string"))
    assert v('{"q": "a"}', "q") == "a" and v('```json\n{"q": "b"}\n```', "q") == "b"
    assert v('text {"q": {"z": 1}} more', "q") == '{"z":1}'
    assert v("just words {", "conclusion") == "just words {" and v("just words", "reasoning") == ""


def test_groups_are_full_and_cover_everything(spark):
    t = spark.range(137).select(F.lit("u").alias("user_id"), F.concat(F.lit("t"), "id").alias("thread_id"))
    t = t.unionByName(t.filter("thread_id = 't3'").withColumn("user_id", F.lit("v")))
    g = tagging.tag_groups(t)
    assert g.count() == 138 and g.select("user_id", "group_id", "pos").distinct().count() == 138
    sizes = [r[1] for r in rows(g.filter("user_id = 'u'").groupBy("group_id").count())]
    assert sorted(sizes) == [7] + [10] * 13
    assert rows(tagging.route(t)) == [("u", 137, "batch"), ("v", 1, "direct")]


def test_requests_hold_every_line(spark):
    lines = spark.createDataFrame(
        [("u", "g0", 0, "t", 0, "", "# thread 0"), ("u", "g0", 0, "t", 2, "b", "person: b"),
         ("u", "g0", 0, "t", 2, "a", "person: a"), ("u", "g1", 0, "s", 0, "", "# thread 0" * 9)],
        "user_id string, group_id string, pos bigint, thread_id string, section int, at string, line string")
    got = tagging.build_requests(lines)
    assert rows(got, "group_id", "n_lines", "request") == [
        ("g0", 3, "# thread 0\nperson: a\nperson: b"), ("g1", 1, "# thread 0" * 9)]


def test_request_wording_by_status(spark):
    a = spark.createDataFrame(
        [("u", "t", "m", str(i), f"f{i}", s, "txt") for i, s in
         enumerate(("ok", "truncated", "failed", "unsupported"))],
        "user_id string, thread_id string, message_id string, attachment_id string, name string, "
        "scan_status string, text string")
    lines = [r[0] for r in rows(tagging.attachment_lines(a, 9), "line")]
    assert lines == ["file: f0 txt", "file: f1 [first 9 characters] txt", "file: f2 [no text]",
                     "file: f3 [type not read]"]


def test_replies_by_position(spark):
    b = spark.createDataFrame(
        [("u", "b", g, p, f"{g}{p}") for g, n in (("g0", 2), ("g1", 1), ("g2", 1)) for p in range(n)],
        "user_id string, batch_id string, group_id string, pos bigint, thread_id string")
    r = spark.createDataFrame(
        [("b", "g0", "succeeded", '[["a"],["b"]]'), ("b", "g1", "errored", '[["x"]]'),
         ("b", "gone", "succeeded", '[["x"]]')],
        "batch_id string, group_id string, status string, reply string")
    tagged = tagging.join_replies(b, r)
    assert rows(tagged, "thread_id", "tags") == [("g00", ["a"]), ("g01", ["b"])]
    assert rows(tagging.remainder(b, tagged), "thread_id") == [("g10",), ("g20",)]


def test_edit_tags(spark):
    t = spark.createDataFrame([("u", "t", ["Old", "keep"], False), ("u", "s", ["x"], False)],
                              "user_id string, thread_id string, user_tags array<string>, manually_reviewed boolean")
    e = spark.createDataFrame(
        [("u", "t", ["New ", "KEEP", ""], ["old"]), ("u", "s", ["y"] * 21, []), ("u", "none", ["z"], [])],
        "user_id string, thread_id string, add array<string>, remove array<string>")
    assert rows(tagging.edit_tags(t, e), "thread_id", "user_tags", "manually_reviewed") == [
        ("s", ["x"], False), ("t", ["keep", "new"], True)]


def test_repeated_edits_and_tags_keep_one_thread(spark):
    t = spark.createDataFrame([("u", "t", ["a"], False)],
                              "user_id string, thread_id string, user_tags array<string>, manually_reviewed boolean")
    e = spark.createDataFrame(
        [("u", "t", ["b"], [], 1), ("u", "t", ["c"], ["a", "b"], 2), ("u", "t", ["b", "c"], [], 3)],
        "user_id string, thread_id string, add array<string>, remove array<string>, seq int")
    assert rows(tagging.edit_tags(t, e), "user_tags") == [(["c", "b"],)]
    tags = spark.createDataFrame([("u", "t", ["new"], True, 2), ("u", "t", ["old"], False, 1)],
                                 "user_id string, thread_id string, tags array<string>, truncated boolean, seq int")
    t = t.selectExpr("user_id", "thread_id", "user_tags AS ai_tags", "false AS tags_truncated")
    assert rows(tagging.set_tags(t, tags), "ai_tags", "tags_truncated") == [(["new"], True)]


def test_set_tags_allows_empty(spark):
    t = spark.createDataFrame([("u", "t", ["a"], False), ("u", "s", ["b"], False)],
                              "user_id string, thread_id string, ai_tags array<string>, tags_truncated boolean")
    g = spark.createDataFrame([("u", "t", [], True)],
                              "user_id string, thread_id string, tags array<string>, truncated boolean")
    assert rows(tagging.set_tags(t, g), "thread_id", "ai_tags", "tags_truncated") == [
        ("s", ["b"], False), ("t", [], True)]


def test_scalar_rules(spark):
    num = lambda v: one(spark, values.positive_int(F.lit(v)))
    assert (num("12"), num(" 7 "), num("0"), num("-3"), num("x"), num(""), num(None)) == (12, 7, None, None, None, None, None)
    kb = lambda v: one(spark, values.size_label_kb(F.lit(v)))
    assert (kb("small"), kb("huge"), kb("odd"), kb(None)) == (10, 5000, None, None)
    cost = lambda *v: one(spark, values.cost(*[F.lit(x) for x in v]))
    assert cost(0, 0, 0, 0) == 0 and cost(2, 0, 10**6, 10**6) == 6.0 and cost(2, 2, 10**6, 10**6) == 3.0
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    old = lambda v: one(spark, values.expired(F.lit(v), now))
    assert old("2024-01-31T00:00:00+00:00") and not old("2024-02-01T00:00:00") and not old("bad") and not old(None)
    assert not old("2024-01-31T00:00:01+00:00")


def test_many_edits_against_one_after_the_other(spark):
    rng = random.Random(8)
    names = ["a", "B", "c ", "d", "e", ""]
    pick = lambda: [rng.choice(names) for _ in range(rng.randint(0, 3))]
    edits = [("u", f"t{rng.randint(0, 5)}", pick(), pick(), k) for k in range(150)]
    start = {f"t{k}": [["a", "B"], ["C", "c"], [], None, ["d"], ["x"], ["y"]][k] for k in range(7)}
    t = spark.createDataFrame([("u", k, v, False) for k, v in start.items()],
                              "user_id string, thread_id string, user_tags array<string>, manually_reviewed boolean")
    e = spark.createDataFrame(edits, "user_id string, thread_id string, add array<string>, remove array<string>, seq int")
    want = {k: list(v or []) for k, v in start.items()}
    clean = lambda tags: list(dict.fromkeys(x.strip().lower() for x in tags if x.strip()))
    for _, k, add, remove, _ in edits:
        want[k] = [x for x in want[k] if x.lower() not in clean(remove)]
        want[k] += [x for x in clean(add) if x not in [y.lower() for y in want[k]]]
    got = tagging.edit_tags(t, e)
    assert {r.thread_id: r.user_tags for r in got.collect()} == want
    assert "seq" not in got.columns and got.filter("manually_reviewed").count() == len({x[1] for x in edits})


def test_batches_are_collected_once(spark, tmp_path):
    from threadlens.operators import batches

    root, now = str(tmp_path / "b"), F.lit("2024-03-10 00:00:00").cast("timestamp")
    known = spark.createDataFrame(
        [("u", "b1", "ended", "2024-03-01"), ("u", "b2", "in_progress", "2024-01-01"), ("v", "b3", "unknown", "2024-01-01"),
         ("v", "b4", "unknown", "2024-03-09")], "user_id string, batch_id string, status string, submitted_at string")
    places = spark.createDataFrame(
        [("u", "b1", "g0", 0, "x"), ("u", "b1", "g0", 1, "y"), ("u", "b1", "g1", 0, "z"), ("u", "b2", "g0", 0, "w")],
        "user_id string, batch_id string, group_id string, pos long, thread_id string")
    replies = spark.createDataFrame(
        [("b1", "g0", "succeeded", '[["p"], ["q"]]', 5, None, 1), ("b1", "g1", "errored", None, 9, 9, 9),
         ("b2", "g0", "succeeded", '[["r"]]', 7, 7, 7)],
        "batch_id string, group_id string, status string, reply string, input_tokens long, output_tokens long, "
        "cache_read_tokens long")
    moved = batches.collect(known, places, replies, now, root)
    assert rows(moved, "batch_id", "state") == [("b1", "collected"), ("b2", "kept"), ("b3", "expired"), ("b4", "kept")]
    see = lambda: [rows(batches.read(spark, root, "tags"), "thread_id", "tags"), rows(batches.read(spark, root, "left"), "thread_id"),
                   rows(batches.read(spark, root, "usage"), "batch_id", "requests", "input_tokens", "output_tokens")]
    once = [[("x", ["p"]), ("y", ["q"])], [("z",)], [("b1", 1, 5, 0)]]
    assert see() == once
    # Again: only what is still open moves.
    assert rows(batches.collect(known, places, replies, now, root), "batch_id", "state") == [("b2", "kept"), ("b4", "kept")]
    assert see() == once
    later = known.withColumn("status", F.lit("ended"))
    assert rows(batches.collect(later, places, replies, now, root), "batch_id", "state")[0] == ("b2", "collected")
    assert see()[0] == [("w", ["r"]), ("x", ["p"]), ("y", ["q"])] and len(see()[2]) == 2


def test_a_collection_that_died_before_its_ledger_is_repeated_in_place(spark, tmp_path, monkeypatch):
    from threadlens.operators import batches

    root, now = str(tmp_path / "b"), F.lit("2024-03-10 00:00:00").cast("timestamp")
    known = spark.createDataFrame([("u", "b1", "ended", "2024-03-01")],
                                  "user_id string, batch_id string, status string, submitted_at string")
    places = spark.createDataFrame([("u", "b1", "g0", 0, "x")],
                                   "user_id string, batch_id string, group_id string, pos long, thread_id string")
    replies = spark.createDataFrame(
        [("b1", "g0", "succeeded", '[["p"]]', 5, 6, 1)], "batch_id string, group_id string, status string, reply string, "
        "input_tokens long, output_tokens long, cache_read_tokens long")
    write = batches._write

    def dies(df, folder, table):
        if table == "ledger":
            raise RuntimeError("lost")
        write(df, folder, table)

    monkeypatch.setattr(batches, "_write", dies)
    with pytest.raises(RuntimeError):
        batches.collect(known, places, replies, now, root)
    monkeypatch.setattr(batches, "_write", write)
    assert rows(batches.collect(known, places, replies, now, root), "state") == [("collected",)]
    assert rows(batches.read(spark, root, "tags"), "thread_id", "tags") == [("x", ["p"])]
    assert rows(batches.read(spark, root, "usage"), "requests", "input_tokens") == [(1, 5)]
