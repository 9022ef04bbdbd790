"""Personal data: fixed patterns, and further spans found by weak supervision.

The base patterns give e-mail addresses, IP addresses, card and phone numbers.
Further candidates (long keys, and numbers inside digit runs that the card pattern
drops as a whole) get votes of five labelers: a shape regex, a checksum or variety
test, a gazetteer of words before the span, the punctuation around it, and its
place in the line. Expectation-maximisation over the counts of all vote patterns
estimates how reliable each labeler is; its posteriors train a logistic span
classifier over votes and span features, which decides. Votes and features have
few values, so the counted patterns are a bounded table however large the input,
and every candidate of every text is in it.

Defined results: a null or empty text has no spans (``base_sha256`` of the empty
string); repeated rows are judged one by one; null ids stay null; an empty table
gives no rows. Base spans are never dropped or changed. All scans are linear in
the text's length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, slices, stored, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "secret")
KINDS = (*BASE, *ADDED)
LABELERS = 5

# The base patterns, written so that no position is scanned twice.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")

# Candidates of the method.
_key = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_-]{16,}+")
_number = re.compile(r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])")
_before = re.compile(r"([^\W\d_]+)[^\w\n]*$")
#: Words that announce a key or a number.
GAZETTEER = frozenset(
    "token secret password passwd pwd key apikey auth bearer credential credentials card account iban visa "
    "mastercard konto karte kontonummer carte compte cuenta tarjeta clave passwort".split())


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns by start, then kind as listed; code points."""
    out = []
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
        at = done = m.end() if m else at + 1
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _phone.finditer(text):
                if 10 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def votes(text: str, start: int, end: int, kind: str) -> list[int]:
    """Votes of the labelers for one candidate: 1 personal, -1 not, 0 no opinion."""
    span = text[start:end]
    left = text[max(0, start - 48):start]
    m = _before.search(left)
    known = m is not None and m[1].lower() in GAZETTEER
    assigned = re.search(r"[=:]\s*[\"']?$", left) is not None
    digits = [c for c in span if c.isdigit()]
    if kind == "account":
        shape = 1 if re.fullmatch(r"[3-6][0-9]{3}([ -]?[0-9]{4}){3}|3[47][0-9]{13}", span) else 0
        check = 1 if 13 <= len(digits) <= 19 and luhn("".join(digits)) else -1
    else:
        hexadecimal = re.fullmatch(r"[0-9a-f]{24,}|[0-9A-F]{24,}", span) is not None
        shape = 1 if hexadecimal or (len(span) >= 20 and digits and re.search("[A-Z]", span) and re.search("[a-z]", span)) else -1
        variety = len(set(span)) / min(len(span), 16)
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:])) / len(span)
        check = 1 if variety > 0.6 and changes > 0.15 else -1 if changes < 0.05 else 0
    around = -1 if text[start - 1:start] in ("/", "#", "?", "&", "<") or text[end:end + 1] in ("/", ">") else 1 if assigned else 0
    line = text.rfind("\n", max(0, start - 200), start)
    alone = 1 if assigned and known else -1 if line == start - 1 and text[end:end + 1] in ("", "\n") else 0
    return [shape, check, 1 if known else 0, around, alone]


def disjoint(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what some spans cover together, in order."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, pattern) of the method's candidates outside the base spans.

    ``pattern`` packs the kind, the votes and a class of length; see :func:`unpacked`.
    """
    if not _digit.search(text):
        return []
    out, taken = [], [(s, e) for s, e, _ in base]
    for kind, pattern in (("account", _number), ("secret", _key)):
        # Matches of one kind never overlap, so only what was taken before them counts.
        starts, ends = disjoint(taken)
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == "secret" and (not _digit.search(m[0]) or not re.search("[A-Za-z]", m[0])):
                continue
            last = bisect_left(starts, e) - 1
            if last >= 0 and ends[last] > s:
                continue
            code = 0
            for v in votes(text, s, e, kind):
                code = code * 3 + v + 1
            length = min(3, (e - s) // 16)
            out.append((s, e, kind, (code * 4 + length) * len(ADDED) + ADDED.index(kind)))
            taken.append((s, e))
    return sorted(out)


def unpacked(pattern: int) -> tuple[str, int, list[int]]:
    """(kind, class of length, votes) of a pattern."""
    rest, kind = divmod(pattern, len(ADDED))
    code, length = divmod(rest, 4)
    got = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        got.append(v - 1)
    return ADDED[kind], length, got[::-1]


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: (posterior of each vote pattern, P(vote | class) of each labeler).

    ``v`` holds votes by pattern and labeler, ``n`` the pattern's count. Having no
    opinion says nothing about the class. The prior counts say that labelers are
    right more often than not, so that even one candidate has a defined posterior.
    """
    prior = np.array([[0.8, 0.2], [0.2, 0.8]]) * 10  # class x vote (-1, 1)
    seen = np.stack([v == -1, v == 1], 2).astype(float)
    p, share = np.tile(prior[:, None] / prior.sum(1)[:, None, None], (1, v.shape[1], 1)), 0.5
    q = np.zeros(len(v))
    for _ in range(rounds):
        log = np.einsum("plv,clv->pc", seen, np.log(p)) + np.log([1 - share, share])
        q = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        for c, w in enumerate((n * (1 - q), n * q)):
            counts = np.einsum("p,plv->lv", w, seen) + prior[c]
            p[c] = counts / counts.sum(1, keepdims=True)
        share = float(np.clip(((n * q).sum() + 2) / (n.sum() + 4), 0.02, 0.98))
    return q, p


def trained(counts: dict[int, int], rounds: int = 400) -> dict[int, float]:
    """The span classifier's probability for each counted pattern."""
    out: dict[int, float] = {}
    for kind in ADDED:
        own = sorted(p for p in counts if unpacked(p)[0] == kind)
        if not own:
            continue
        v = np.array([unpacked(p)[2] for p in own])
        n = np.array([counts[p] for p in own], float)
        q, _ = reliabilities(v, n)
        length = np.eye(4)[[unpacked(p)[1] for p in own]]
        x = np.hstack([v == 1, v == -1, length, np.ones((len(own), 1))]).astype(float)
        w = np.zeros(x.shape[1])
        weight = n / n.sum()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(x @ w)))
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            step = np.linalg.solve(curve, x.T @ (weight * (q - p)) - 1e-3 * w)
            w += np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        out |= dict(zip(own, 1 / (1 + np.exp(-(x @ w))), strict=True))
    return out


def described(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


_SPAN = "array<struct<start:int,end:int,kind:string,pattern:int>>"


def found(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep``, ``base`` and ``more`` (spans of the base patterns, candidates) for every row."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = [f.name for f in fields]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pattern", pa.int32())]))
    row = lambda s: {"start": s[0], "end": s[1], "kind": s[2], "pattern": s[3] if len(s) > 3 else None}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            base, more = [], []
            for t in batch.column("_text").to_pylist():
                own = base_spans(t)
                base.append([row(s) for s in own])
                more.append([row(s) for s in candidates(t, own)])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(base, kind), pa.array(more, kind)], names=[*names, "base", "more"])

    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    source = docs.select(*[F.col(n) for n in names], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return source.mapInArrow(scan, f"{columns}base {_SPAN}, more {_SPAN}")


def accepted(spans: DataFrame, least: float = 0.5) -> list[int]:
    """The patterns whose spans the classifier takes; only counts by pattern reach the driver."""
    counts = spans.select(F.explode("more.pattern").alias("p")).groupBy("p").count().collect()
    return sorted(p for p, score in trained({r.p: r["count"] for r in counts}).items() if score >= least)


def _text_of(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base spans and those that the span classifier adds."""
    spans = stored(found(only(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id"), "pii")
    take = accepted(spans)
    added = F.filter("more", lambda s: s["pattern"].isin(take)) if take else F.array().cast(_SPAN)
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.transform(F.concat("base", added), lambda s: F.struct(
        s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id", *[number(k) for k in BASE], F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.sort_array(keyed)).alias("spans"), F.size(added).cast("long").alias("n_added"))


def redacted(docs: DataFrame, take: list[int], text: str = "text") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets."""
    names, chosen = docs.columns, frozenset(take)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = [None if t is None else masked(t, chosen) for t in batch.column(text).to_pylist()]
            columns = [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(rewrite, docs.schema)


def masked(text: str, chosen: frozenset[int]) -> str:
    base = base_spans(text)
    spans = sorted([*base, *[s[:3] for s in candidates(text, base) if s[3] in chosen]], key=lambda s: (s[0], -s[1]))
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(text: str) -> str:
    """``base_sha256`` of one text, for tests and readers."""
    return hashlib.sha256(described(base_spans(text)).encode()).hexdigest()


def pattern_counts(texts: list[str]) -> Counter:
    """Counts of the candidates' patterns in some texts."""
    return Counter(s[3] for t in texts for s in candidates(t, base_spans(t)))


QUERIES = {"op3_pii": op3_pii}
SQL: dict[str, str] = {}
