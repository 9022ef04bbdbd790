"""Conversation repair against a plain search over all edits, and SQL."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from check import compare, database
from pyspark.sql import functions as F

from threadlens.llm import turnrepair

SF = "/root/testdata/sf0.001"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows):
    """(cost, audit, lines) by best-first search over edits; the heap orders equal costs by letters."""
    best, heap = {}, [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(lines)
        # Only what can follow counts: nothing yet, or the last initial.
        key = (i, roles[-1:])
        if key in best and best[key] <= (cost, audit):
            continue
        best[key] = (cost, audit)
        for new in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + new[0], (*lines, f"{new}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + new[0], (*lines, f"{new}:{text}")))


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        of = convs.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if fault == 4 else role
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        of += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return sorted([(conv, *summary(of)) for conv, of in convs.items()], key=str)


def summary(of):
    of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, judged, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in of:
        bare = text.rstrip(SPACES)
        fault = ("blank" if not bare else "duplicate" if (role, text) in seen else
                 "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
        judged.append((role, text, fault))
        if fault:
            n[fault] += 1
    turns = [t for t, *_ in of if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(of, of[1:]))
    cost, audit, lines = cheapest(judged)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "sage", None]
TEXTS = ["One. ", "Two!\n", "Three?", "cut off", "also cut", "", " \t", None, "é.", "\x0b.", " ", "same."]


def made(seed, convs, longest):
    r = random.Random(seed)
    out = []
    for conv in convs:
        for k in range(r.randint(1, longest)):
            turn = None if r.random() < 0.03 else k + r.choice([0, 0, 0, 1, 4])
            role = ["user", "assistant"][k % 2] if r.random() < 0.6 else r.choice(ROLES)
            row = (conv, turn, role, r.choice(TEXTS) if r.random() < 0.4 else f"Text {k}{r.choice(['.', '!', ''])}")
            out += [row] * r.choice([1, 1, 1, 1, 2])
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("n", "fault", "piece", "digest", "kind", "first", "copy")})


def have(df):
    names = ["conv_id", *turnrepair.TOTALS, "audit", "repaired_sha256"]
    assert df.columns == names
    return sorted([tuple(r) for r in df.collect()], key=str)


def query(rows):
    return turnrepair.digest(turnrepair.repaired(turnrepair.damaged(rows)))


def test_tables_are_exact():
    t, r = turnrepair.Tables(), random.Random(5)
    for vector in t.vectors:
        assert min(vector) == 0 and max(vector) <= 10
    for n in [*range(12), 37, 200]:
        symbols = [r.randrange(8) for _ in range(n)]
        rows = [("suax"[s // 2], f"t{k}", "truncated" if s % 2 else None) for k, s in enumerate(symbols)]
        _, vector, cost = t.behind(symbols, 0)
        audit, lines = turnrepair.edited(symbols, [x[0] for x in rows], [x[1] for x in rows], [0] * n, 0, 0, 0, True)
        assert (cost + t.vectors[vector][0], audit, lines or "") == cheapest(rows)
        # Parts summed apart and chained give the same.
        cut = r.randint(0, n)
        to, adds, ends = t.summed(symbols[cut:])
        front_to, front_adds, front_ends = t.summed(symbols[:cut])
        assert front_to[to[0]] == vector and adds[0] + front_adds[to[0]] == cost
        state = t.trace(symbols, 0, 0)[1]
        assert ends[0][front_ends[to[0]][0]] == state


def test_made_conversations(spark):
    rows = made(1, [*range(60), None], 14) + [(900, 1, None, None), (901, None, "user", "x."), (902, 3, "system", "s.")]
    rows += [(1000 + k, k, "user", "Hi.") for k in range(60)]  # some lose their only row
    found = have(query(frame(spark, rows)))
    assert found == expected(rows)
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in found)


def test_one_conversation_over_all_partitions(spark):
    """Nearly all rows are of one conversation, equal rows among them, so partitions cut it."""
    rows = made(2, [7], 400) + made(3, [1, 20], 4) + [(7, 50, "user", "again.")] * 300
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        pieces = turnrepair.repaired(turnrepair.damaged(frame(spark, rows)))
        assert pieces.where("conv_id = 7").count() > 4
        assert have(query(frame(spark, rows))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_general_interface_has_the_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 1, "user", "A.", 1), (1, 2, "user", "B", 1), (2, 1, "assistant", "C.", 0)],
                                 "conv_id long, turn long, role string, text string, n long")
    whole = {}
    for r in sorted(turnrepair.repaired(rows).collect(), key=lambda r: r.piece):
        audit, lines, _ = whole.get(r.conv_id, ("", [], None))
        whole[r.conv_id] = audit + r.audit, lines + [r.repaired] * (r.repaired is not None), r.cost
        assert r.final == (r.cost is not None)
    assert whole == {1: ("KR", ["user:A.", "assistant:B"], 6), 2: ("", [], 0)} or whole == {
        1: ("KR", ["user:A.\nassistant:B"], 6), 2: ("", [], 0)}


def test_empty_table(spark):
    assert have(query(frame(spark, []))) == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/sf{sf}"
    name = "op13_conversation_repair"
    n, problem = compare(spark, database(path), turnrepair.QUERIES[name], turnrepair.SQL[name], path)
    assert problem is None and n > 0
    if sf == "0.001":
        rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select(
            "conv_id", "turn", "role", "text").collect()]
        assert have(turnrepair.QUERIES[name](spark, path)) == expected(rows)
