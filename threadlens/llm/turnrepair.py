"""Repair of the turn structure of conversations by block tables.

A conversation's rows are edited at least cost until their roles read
``(s?(ua)+)?``. What is left to pay from a row on is a vector of four costs, one a
state (nothing yet, after s, after u, after a). Less its least entry such a vector
takes few values, for no two entries differ by more than ten. So the step over every
block of four rows from every vector is computed once a worker (the Four-Russians
method): the vector before the block, what the block adds, and the state it leads to
from each state. Rows are processed block by block, from the last, by lookup. To name
the edits a block is expanded backward from the vector behind it; row by row the
first letter that keeps to a cheapest path is taken, so of all cheapest edits the
ASCII-least are found.

Rows are sorted over range partitions, not by conversation. A conversation inside one
partition is finished there. One that a partition's end cuts is a few pieces; each
piece is summed up for every vector behind it, those sums (one row a piece) are
chained per conversation, and then all pieces are edited apart. Repeated rows are
counted before they are shuffled. So no conversation meets in one task but for what
is one value by nature: its edits in order, and a digest over all it holds, which is
fed piece by piece.

Order and defined results: rows are taken by turn (null first), then role, then
SHA-256 of the text. Null roles and texts are one space; null conversation ids are
one conversation. Duplicates of a row are all but the first in that order. Rows must
be deleted that are blank or duplicate, and those go before any insertion at the same
place. An empty table gives no rows; further input columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, partitions, stored, table

#: Rows in a block of the tables.
BLOCK = 4
START, S, U, A = range(4)
#: The state after an inserted or relabelled row, and the role it gets.
NEXT, GIVEN = (U, U, A, U), ("user", "user", "assistant", "user")
#: Where a kept row leads, by state and the initial of its role; -1 is not allowed.
KEPT = ((S, U, -1, -1), (-1, U, -1, -1), (-1, -1, A, -1), (-1, U, -1, -1))
KEEP, RELABEL, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What is left to pay, and the edits left, behind the last row.
FINAL, CLOSING = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
SYMBOLS = 8

_tables: list["Tables"] = []


def step(after: tuple, symbol: int) -> tuple:
    """Costs before a row from those behind it; ``symbol`` is 2 * initial + truncated."""
    initial, more = symbol // 2, TRUNCATED * (symbol % 2)
    row = []
    for q in range(4):
        costs = [DELETE + after[q], RELABEL + more + after[NEXT[q]]]
        if KEPT[q][initial] >= 0:
            costs.append(KEEP + more + after[KEPT[q][initial]])
        row.append(min(costs))
    u, a = min(row[U], INSERT + row[A]), min(row[A], INSERT + row[U])
    return min(row[START], INSERT + u), min(row[S], INSERT + u), u, a


def edits(before: tuple, after: tuple, symbol: int, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits up to and including a row, and the state behind it."""
    initial, more, out = symbol // 2, TRUNCATED * (symbol % 2), ""
    while True:
        if before[state] == DELETE + after[state]:
            return out + "D", state
        if before[state] == INSERT + before[NEXT[state]]:
            out, state = out + "I", NEXT[state]
            continue
        kept = KEPT[state][initial]
        if kept >= 0 and before[state] == KEEP + more + after[kept]:
            return out + "K", kept
        return out + "R", NEXT[state]


class Tables:
    """Steps from every normalised vector, for single rows and for all blocks of four."""

    def __init__(self):
        self.vectors, number = [FINAL], {FINAL: 0}
        steps = []
        for vector in self.vectors:  # grows while it is read
            for symbol in range(SYMBOLS):
                before = step(vector, symbol)
                least = min(before)
                normal = tuple(c - least for c in before)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                steps.append((number[normal], least, [edits(before, vector, symbol, q) for q in range(4)]))
        n = len(self.vectors)
        self.to = np.array([x[0] for x in steps], np.int32).reshape(n, SYMBOLS)
        self.adds = np.array([x[1] for x in steps], np.int64).reshape(n, SYMBOLS)
        self.ends = np.array([[q for _, q in x[2]] for x in steps], np.int8).reshape(n, SYMBOLS, 4)
        self.edits = [[steps[v * SYMBOLS + s][2] for s in range(SYMBOLS)] for v in range(n)]
        self.block_to, self.block_adds, self.block_ends = self.to, self.adds, self.ends
        for _ in range(BLOCK - 1):
            self.block_to, self.block_adds, self.block_ends = self._joined(
                self.block_to, self.block_adds, self.block_ends)
        self.rows_to, self.rows_block_to = self.to.tolist(), self.block_to.tolist()
        self.rows_adds, self.rows_block_adds = self.adds.tolist(), self.block_adds.tolist()

    def _joined(self, to: np.ndarray, adds: np.ndarray, ends: np.ndarray) -> tuple:
        """The tables of blocks with one more row in front: code = symbol * size + code of the rest."""
        n, size = to.shape
        front = self.to[to]  # vector, rest, symbol
        joined_adds = adds[:, :, None] + self.adds[to]
        first = self.ends[to]  # state behind the row in front
        v, rest = np.arange(n)[:, None, None, None], np.arange(size)[None, :, None, None]
        joined_ends = ends[v, rest, first]
        flat = lambda x: np.ascontiguousarray(np.swapaxes(x, 1, 2)).reshape(n, size * SYMBOLS, *x.shape[3:])
        return flat(front), flat(joined_adds), flat(joined_ends)

    @staticmethod
    def codes(symbols: list[int]) -> list[int]:
        """The codes of the whole blocks, from the first row; up to three rows are left over behind them."""
        return [((symbols[k] * SYMBOLS + symbols[k + 1]) * SYMBOLS + symbols[k + 2]) * SYMBOLS + symbols[k + 3]
                for k in range(0, len(symbols) - BLOCK + 1, BLOCK)]

    def behind(self, symbols: list[int], vector: int) -> tuple[list[int], int, int]:
        """The vectors behind each block, that before all rows, and the cost added."""
        codes, cost = self.codes(symbols), 0
        for s in reversed(symbols[len(codes) * BLOCK:]):
            cost += self.rows_adds[vector][s]
            vector = self.rows_to[vector][s]
        out = [0] * len(codes)
        for k in range(len(codes) - 1, -1, -1):
            out[k] = vector
            cost += self.rows_block_adds[vector][codes[k]]
            vector = self.rows_block_to[vector][codes[k]]
        return out, vector, cost

    def trace(self, symbols: list[int], vector: int, state: int) -> tuple[list[str], int]:
        """The edits of each row with ``vector`` behind the last one, and the state there."""
        bounds, _, _ = self.behind(symbols, vector)
        out: list[str] = []
        for k in range(0, len(symbols), BLOCK):
            block = symbols[k:k + BLOCK]
            after = [bounds[k // BLOCK] if k // BLOCK < len(bounds) else vector]
            for s in reversed(block[1:]):
                after.append(self.rows_to[after[-1]][s])
            for s, v in zip(block, reversed(after), strict=True):
                letters, state = self.edits[v][s][state]
                out.append(letters)
        return out, state

    def summed(self, symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From every vector behind the rows: the vector before them, the cost added, the state reached from each."""
        n, codes = len(self.vectors), self.codes(symbols)
        to, adds, ends = np.arange(n), np.zeros(n, np.int64), np.tile(np.arange(4, dtype=np.int8), (n, 1))
        every = np.arange(n)[:, None]
        for s in reversed(symbols[len(codes) * BLOCK:]):
            ends, adds, to = ends[every, self.ends[to, s]], adds + self.adds[to, s], self.to[to, s]
        for c in reversed(codes):
            ends, adds, to = ends[every, self.block_ends[to, c]], adds + self.block_adds[to, c], self.block_to[to, c]
        return to, adds, ends


def tables() -> Tables:
    """The worker's tables."""
    if not _tables:
        _tables.append(Tables())
    return _tables[0]


class Piece:
    """The rows of one conversation that lie in one partition, in order."""

    COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns")

    def __init__(self, conv: object):
        self.conv = conv
        #: Per row to edit: its symbol, role, text, and the rows to be deleted before it.
        self.symbols, self.roles, self.texts, self.before = [], [], [], []
        #: Rows to be deleted behind the last one to edit.
        self.tail = 0
        self.n_rows = self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first = self.last = None
        self.turn_first = self.turn_last = None

    def add(self, turn: int | None, role: str, text: str | None, kind: int, n: int) -> None:
        """``n`` equal rows; ``text`` is null unless the first of them is the first of its kind."""
        if n == 0:
            return
        initial = role[:1]
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in LEGAL)
        if self.first is None:
            self.first = initial
        self.last = initial
        self.n_rows += n
        if turn is not None and turn != self.turn_last:
            self.n_turns += 1
            self.turn_last = turn
            if self.turn_first is None:
                self.turn_first = turn
        if kind == BLANK:
            self.blank += n
            self.tail += n
        elif text is None:
            self.duplicate += n
            self.tail += n
        else:
            self.duplicate += n - 1
            self.truncated += kind
            at = INITIALS.find(initial) if initial else -1
            self.symbols.append(2 * (at if at >= 0 else 3) + kind)
            self.roles.append(role)
            self.texts.append(text)
            self.before.append(self.tail)
            self.tail = n - 1

    @property
    def deleted(self) -> int:
        return sum(self.before) + self.tail


#: Kinds of text: ends in one of .!?, does not, has nothing to see.
WHOLE, CUT, BLANK = range(3)


def edited(symbols: list[int], roles: list[str], texts: list[str], before: list[int], tail: int,
           vector: int, state: int, last: bool) -> tuple[str, str | None]:
    """The edits of a piece, and its repaired rows as ``role:text`` lines (null for none)."""
    per_row, _ = tables().trace(symbols, vector, state)
    audit, lines = [], []
    for symbol, role, text, gone, letters in zip(symbols, roles, texts, before, per_row, strict=True):
        audit.append("D" * gone + letters)
        for c in letters:
            if c == "K":
                lines.append(f"{role}:{text}")
                state = KEPT[state][symbol // 2]
            elif c != "D":
                lines.append(f"{GIVEN[state]}:{text if c == 'R' else ''}")
                state = NEXT[state]
    audit.append("D" * tail)
    if last:
        for c in CLOSING[state]:
            audit.append(c)
            lines.append(f"{GIVEN[state]}:")
            state = NEXT[state]
    return "".join(audit), "\n".join(lines) if lines else None


def occurrences(rows: DataFrame) -> DataFrame:
    """The rows without their texts, equal ones counted, and each distinct row of a conversation once with its text.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` and ``n``, how often a row
    counts. Both kinds sort together: first the count, then the text.
    """
    digest = F.unhex(F.sha2("text", 256))
    kind = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
            .when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), WHOLE).otherwise(CUT)).cast("int")
    marked = rows.select("conv_id", "turn", "role", "text", digest.alias("digest"), kind.alias("kind"), "n")
    counts = marked.groupBy("conv_id", "turn", "role", "digest", "kind").agg(F.sum("n").alias("n"))
    firsts = marked.where("n > 0").groupBy("conv_id", "role", "text").agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"))
    turn = F.when(~F.col("none"), F.col("least"))
    texts = firsts.select("conv_id", turn.alias("turn"), "role", digest.alias("digest"), kind.alias("kind"),
                          F.lit(None).cast("long").alias("n"), "text")
    return counts.withColumn("text", F.lit(None).cast("string")).unionByName(texts)


def pieces(rows: DataFrame) -> DataFrame:
    """One row a piece, stored: finished conversations edited, cut ones summed up and with their rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn_type = rows.schema["turn"].dataType.simpleString()
    keys = ["conv_id", "turn", "role", "digest"]
    ordered = occurrences(rows).repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(
        *keys, F.col("text").isNotNull())
    names = ["conv_id", "piece", "cut", *Piece.COUNTS, "first", "last", "turn_first", "turn_last", "cost", "audit", "repaired",
             "symbols", "roles", "texts", "before", "tail", "to", "adds", "ends"]
    types = [kind, "long", "boolean", *["long"] * len(Piece.COUNTS), "string", "string", turn_type, turn_type, "long", "string",
             "string", "array<tinyint>", "array<string>", "array<string>", "array<long>", "long", "array<int>",
             "array<long>", "array<tinyint>"]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True))

    def finished(p: Piece, number: int, cut: bool) -> tuple:
        head = (p.conv, number, cut, *[getattr(p, c) for c in Piece.COUNTS], p.first, p.last, p.turn_first, p.turn_last)
        if cut:
            to, adds, ends = tables().summed(p.symbols)
            adds = adds + DELETE * p.deleted
            return *head, None, None, None, p.symbols, p.roles, p.texts, p.before, p.tail, to, adds, ends.ravel()
        _, vector, cost = tables().behind(p.symbols, 0)
        cost += tables().vectors[vector][START] + DELETE * p.deleted
        audit, lines = edited(p.symbols, p.roles, p.texts, p.before, p.tail, 0, START, True)
        return *head, cost, audit, lines, *[None] * 8

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        arrow = None
        now, out, size, pending = None, [], 0, None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], arrow)

        for incoming in batches:
            if arrow is None:
                arrow = _arrow(names, types, incoming.schema)
            for conv, turn, role, text, sort, n in zip(*[incoming.column(c).to_pylist() for c in (
                    "conv_id", "turn", "role", "text", "kind", "n")], strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        if pending:
                            now.add(*pending)
                        out.append(finished(now, number, number & 0xFFFFFFFF == 0))
                        size += sum(map(len, now.texts))
                        number += 1
                        if size > 4 << 20 or len(out) >= 2000:
                            yield batch()
                            out, size = [], 0
                    now, pending = Piece(conv), None
                if n is None:  # the text of the rows counted just before
                    now.add(turn, role, text, sort, pending[4])
                    pending = None
                else:
                    if pending:
                        now.add(*pending)
                    pending = (turn, role, None, sort, n)
        if now is not None:
            if pending:
                now.add(*pending)
            out.append(finished(now, number, True))
            yield batch()

    return stored(ordered.select("conv_id", "turn", "role", "text", "kind", "n").mapInArrow(walk, schema), "pieces")


def _arrow(names: list[str], types: list[str], given: pa.Schema) -> pa.Schema:
    known = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<tinyint>": pa.list_(pa.int8()),
             "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    own = {"conv_id": given.field("conv_id").type, "turn_first": given.field("turn").type, "turn_last": given.field("turn").type}
    return pa.schema([pa.field(n, own.get(n) or known[t]) for n, t in zip(names, types, strict=True)])


TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def chained(cut: pa.Table) -> pa.Table:
    """The vector behind each piece of one conversation, the state before it, and the totals on its last piece."""
    rows = sorted(cut.to_pylist(), key=lambda r: r["piece"])
    t, vector, cost = tables(), 0, 0
    for r in reversed(rows):
        r["vector"] = vector
        cost += r["adds"][vector]
        vector = r["to"][vector]
    state, cost = START, cost + t.vectors[vector][START]
    total = {c: sum(r[c] for r in rows) for c in Piece.COUNTS}
    initial = turn = least = None
    for r in rows:
        r["state"], state = state, r["ends"][4 * r["vector"] + state]
        if r["n_rows"]:
            total["illegal"] += initial is not None and initial + r["first"] not in LEGAL
            initial = r["last"]
        if r["turn_first"] is not None:
            total["n_turns"] -= r["turn_first"] == turn
            turn = r["turn_last"]
            least = r["turn_first"] if least is None else least
    total |= {"gaps": 0 if turn is None else turn - least + 1 - total["n_turns"], "cost": cost}
    end = rows[-1]["piece"]
    columns = {"piece": [r["piece"] for r in rows], "vector": [r["vector"] for r in rows], "state": [r["state"] for r in rows],
               "final": [r["piece"] == end for r in rows]}
    columns |= {c: [total[c] if r["piece"] == end else None for r in rows] for c in TOTALS}
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * len(TOTALS)]
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], names=list(columns))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations, one row a piece: ``conv_id``, ``piece``, ``cut``, ``final``, the totals, ``audit``, ``repaired``.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` and ``n`` (rows of n = 0
    only name a conversation). Pieces of a conversation are in order of ``piece``; all
    but a few conversations have one, which is not ``cut``. ``repaired`` holds its rows as ``role:text``
    lines, null for none; the totals stand on the final piece.
    """
    found = pieces(rows)
    gaps = F.coalesce(F.col("turn_last") - F.col("turn_first") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    whole = found.where("NOT cut").select(
        "conv_id", "piece", "cut", F.lit(True).alias("final"), gaps.alias("gaps"), *TOTALS[1:], "audit", "repaired")
    cut = found.where("cut")
    light = cut.select("conv_id", "piece", *Piece.COUNTS, "first", "last", "turn_first", "turn_last", "to", "adds", "ends")
    schema = f"piece long, vector int, state int, final boolean, {', '.join(f'{c} long' for c in TOTALS)}"
    # One small row a piece, and a conversation has at most one piece a partition.
    links = stored(light.groupBy("conv_id").applyInArrow(chained, schema), "chained")
    data = cut.select("conv_id", "piece", "symbols", "roles", "texts", "before", "tail").join(links, "piece")
    names = ["conv_id", "piece", "final", *TOTALS, "audit", "repaired"]
    inputs = ["symbols", "roles", "texts", "before", "tail", "vector", "state", "final"]

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                audit, lines = edited(*[one.column(c)[0].as_py() for c in inputs])
                yield pa.RecordBatch.from_arrays(
                    [*[one.column(c) for c in names[:-2]], pa.array([audit]), pa.array([lines], pa.string())], names=names)

    kind = rows.schema["conv_id"].dataType.simpleString()
    cut_schema = f"conv_id {kind}, piece long, final boolean, {', '.join(f'{c} long' for c in TOTALS)}, audit string, repaired string"
    return whole.unionByName(data.mapInArrow(edit, cut_schema).withColumn("cut", F.lit(True)))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by crc32 of ``conv_id:turn`` mod 20, and ``n``, how often each counts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = only(conversations, "conv_id", "turn", "role", "text").withColumn("fault", fault)
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(text("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(text("text"), "[.!?]", ""))
        .otherwise(text("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("n"))


def digest(found: DataFrame) -> DataFrame:
    """One row a conversation: its totals, edits, and SHA-256 over all its repaired rows."""
    kind = found.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *TOTALS, "audit", "repaired_sha256"]
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in TOTALS)}, audit string, repaired_sha256 string"

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, sha, lines = [], hashlib.sha256(), False
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                audit.append(row.column("audit")[0].as_py())
                text = row.column("repaired")[0].as_py()
                if text is not None:
                    sha.update((b"\n" if lines else b"") + text.encode())
                    lines = True
                if row.column("final")[0].as_py():
                    yield pa.RecordBatch.from_arrays(
                        [row.column("conv_id"), *[row.column(c) for c in TOTALS], pa.array(["".join(audit)]),
                         pa.array([sha.hexdigest()])], names=names)
                    audit, sha, lines = [], hashlib.sha256(), False

    single = found.where("NOT cut").withColumn(
        "repaired_sha256", F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256))
    rest = found.where("cut").repartition(partitions(found.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")
    return single.select(*names).unionByName(rest.mapInArrow(feed, schema))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return digest(repaired(damaged(table(spark, sf_dir, "conversations"))))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}

_CRC = """list_reduce(
    list_concat([4294967295::UBIGINT], flatten(list_transform(range(1, 1 + length(k)),
        lambda i: [ascii(substr(k, i, 1))::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::UBIGINT))"""

SQL = {"op13_conversation_repair": f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), coded AS (
  SELECT conv_id, turn, role, text, xor({_CRC}, 4294967295::UBIGINT) % 20 AS fault FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded
), placed AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS prior, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
         regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_whole FROM placed
), faults AS (
  SELECT *, CASE WHEN is_blank THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT is_whole THEN 't' ELSE '' END AS fault,
         count(*) OVER (PARTITION BY conv_id) AS n FROM judged
), totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
  FROM faults GROUP BY conv_id
), pay AS (
  SELECT conv_id, n + 1 AS i, 0 AS st, 6 AS s, 3 AS u, 0 AS a FROM totals
  UNION ALL
  SELECT conv_id, i, least(r0, 3 + least(ru, 3 + ra)), least(rs, 3 + least(ru, 3 + ra)), least(ru, 3 + ra), least(ra, 3 + ru)
  FROM (
    SELECT f.conv_id, f.i,
           CASE WHEN fault IN ('b', 'd') THEN 4 + p.st ELSE least(4 + p.st, 3 + m + p.u,
                CASE initial WHEN 's' THEN m + p.s WHEN 'u' THEN m + p.u ELSE 4 + p.st END) END AS r0,
           CASE WHEN fault IN ('b', 'd') THEN 4 + p.s ELSE least(4 + p.s, 3 + m + p.u,
                CASE initial WHEN 'u' THEN m + p.u ELSE 4 + p.s END) END AS rs,
           CASE WHEN fault IN ('b', 'd') THEN 4 + p.u ELSE least(4 + p.u, 3 + m + p.a,
                CASE initial WHEN 'a' THEN m + p.a ELSE 4 + p.u END) END AS ru,
           CASE WHEN fault IN ('b', 'd') THEN 4 + p.a ELSE least(4 + p.a, 3 + m + p.u,
                CASE initial WHEN 'u' THEN m + p.u ELSE 4 + p.a END) END AS ra
    FROM pay p JOIN (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS m FROM faults) f
      ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i - 1)
), left_to_pay AS (
  SELECT conv_id, i, unnest(['0', 's', 'u', 'a']) AS q, unnest([st, s, u, a]) AS c FROM pay
), edits AS (
  SELECT conv_id, 1 AS i, '0' AS q, '' AS audit, '' AS body FROM totals
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN q WHEN e = 'K' THEN initial ELSE nx END,
         audit || e, body || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
           ELSE chr(10) || CASE nx WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'R' THEN text ELSE '' END END
  FROM (
    SELECT x.*, f.role, f.text, f.initial,
           CASE WHEN f.i IS NOT NULL AND here.c = 4 + same.c THEN 'D'
                WHEN here.c = 3 + inserted.c THEN 'I'
                WHEN fault NOT IN ('b', 'd') AND (x.q || initial) IN ('0s', '0u', 'su', 'ua', 'au')
                     AND here.c = CASE WHEN fault = 't' THEN 3 ELSE 0 END + kept.c THEN 'K'
                ELSE 'R' END AS e
    FROM (SELECT *, CASE q WHEN 'u' THEN 'a' ELSE 'u' END AS nx FROM edits) x
    JOIN left_to_pay here ON here.conv_id IS NOT DISTINCT FROM x.conv_id AND here.i = x.i AND here.q = x.q
    JOIN left_to_pay inserted ON inserted.conv_id IS NOT DISTINCT FROM x.conv_id AND inserted.i = x.i AND inserted.q = x.nx
    LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i
    LEFT JOIN left_to_pay same ON same.conv_id IS NOT DISTINCT FROM x.conv_id AND same.i = x.i + 1 AND same.q = x.q
    LEFT JOIN left_to_pay kept ON kept.conv_id IS NOT DISTINCT FROM x.conv_id AND kept.i = x.i + 1 AND kept.q = f.initial
    WHERE f.i IS NOT NULL OR x.q IN ('s', 'u'))
), done AS (
  SELECT e.conv_id, e.audit, e.body FROM edits e JOIN totals t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
  WHERE e.i = t.n + 1 AND e.q IN ('0', 'a')
)
SELECT g.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate,
       coalesce(t.truncated, 0) AS truncated, coalesce(t.illegal, 0) AS illegal, coalesce(p.st, 0)::BIGINT AS cost,
       coalesce(d.audit, '') AS audit, sha256(coalesce(substr(d.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN pay p ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.i = 1
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM g.conv_id
"""}
