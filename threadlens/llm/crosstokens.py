"""Alignment of two tokenizers' ids over the same bytes.

Both id lists of a text are laid over its bytes. The byte offsets at which a token
of either list ends are the intersection of two bitmaps of ends; in order they slice
both lists into groups, and all tokens of a group are linked. Many texts are laid out
one behind the other and aligned together, since each of them ends with a shared end.
Counts of linked id pairs say in how many documents of the corpus two ids meet.

Counting is done over blocks of some megabytes of text. Texts are aligned once: a
block stores, for each text, its distinct pairs as places in the block's own list of
pairs, and that list. The lists are summed over blocks, and each block gets back the
counts of the pairs it named. So nothing of the size of the vocabulary product is
broadcast, and a pair that all documents hold is one row a block.

Defined results: null and empty texts, and texts that one of the tokenizers does not
give back byte for byte (such as those holding U+2581), have no tokens: zeros and
an empty ``groups``. Repeated rows and null ids are rows like any other and count as
documents of their own. Further input columns are left out; an empty table gives no
rows. A group of many tokens is linked by its distinct ids, with their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain, compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, slices, stored, table
from .tokens import Encoder, byte_level

#: Bytes of text in a block, one text at least.
BLOCK = 4 << 20
#: Groups of more links than this are linked by their distinct ids.
WIDE = 1 << 16
#: Characters of text that are aligned together, one text at least, and links that are expanded together.
RUN, LINKS = 1 << 18, 1 << 21

_aligners: dict[tuple[str, str], "Aligner"] = {}


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each list lie before every offset where a token of both ends, in order.

    Ends are offsets behind a token, rising; the last one of both lists is equal.
    """
    if len(ends_a) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of_a, of_b = np.zeros((2, ends_a[-1] + 1), bool)
    of_a[ends_a] = of_b[ends_b] = True
    return np.flatnonzero(of_b[ends_a]) + 1, np.flatnonzero(of_a[ends_b]) + 1


def within(values: np.ndarray, until: np.ndarray) -> np.ndarray:
    """The sums of ``values`` from each of the rising places ``until`` back to the one before."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[until], prepend=0)


class Aligned(NamedTuple):
    """A text's ids in groups, and its distinct linked pairs (a << 16 | b) with how many links each has."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    pairs: np.ndarray
    times: np.ndarray
    written: bytes

    def text(self) -> str:
        """The ids as ``a1,a2|b1;a3|b2,b3``: decimal, both sides of a group, groups in order."""
        return self.written.decode("ascii")


class Run:
    """Texts aligned together: their ids and the ends of these lie behind one another.

    Both lists cover the bytes of each text, so that its end is a shared one and no
    group reaches beyond it. ``n_a`` and ``n_b`` are the numbers of ids of each text.
    """

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray,
                 n_a: np.ndarray, n_b: np.ndarray):
        self.ids_a, self.ids_b, self.n_a, self.n_b = ids_a, ids_b, n_a, n_b
        self.stops_a, self.stops_b = shared_ends(ends_a, ends_b)
        self.of_a, self.of_b = np.diff(self.stops_a, prepend=0), np.diff(self.stops_b, prepend=0)
        self.links = self.of_a * self.of_b
        self.until = np.searchsorted(self.stops_a, np.cumsum(n_a), "right")  # groups before each text's end
        self.n_groups, self.n_links = np.diff(self.until, prepend=0), within(self.links, self.until)

    def __iter__(self) -> Iterator[Aligned]:
        written = self._written()
        # Texts are expanded together as long as few links lie before the last one.
        firsts = np.flatnonzero(np.diff((np.cumsum(self.n_links) - self.n_links) // LINKS, prepend=-1)).tolist()
        for first, end in zip(firsts, [*firsts[1:], len(self.n_a)]):
            keys, times = self._expanded(first, end)
            bounds = np.searchsorted(keys, np.arange(end - first + 1) << 32)
            pairs = keys & 0xFFFFFFFF
            for k in range(first, end):
                own = slice(bounds[k - first], bounds[k - first + 1])
                yield Aligned(int(self.n_a[k]), int(self.n_b[k]), int(self.n_groups[k]), int(self.n_links[k]),
                              pairs[own], times[own], written[k])

    def _expanded(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Text (counted from ``first``) << 32 | pair, sorted and distinct, with its links."""
        groups = slice(self.until[first] - self.n_groups[first], self.until[end - 1])
        of_a, of_b, links = self.of_a[groups], self.of_b[groups], self.links[groups]
        start_a, start_b = self.stops_a[groups] - of_a, self.stops_b[groups] - of_b
        text = np.repeat(np.arange(end - first) << 32, self.n_groups[first:end])
        single, wide = links == 1, links > WIDE
        rest = np.flatnonzero(~single & ~wide)
        of = np.repeat(rest, links[rest])
        nth_a, nth_b = np.divmod(np.arange(len(of)) - np.repeat(np.cumsum(links[rest]) - links[rest], links[rest]), of_b[of])
        keys, times = np.unique(np.concatenate([
            text[single] | self.ids_a[start_a[single]] << 16 | self.ids_b[start_b[single]],
            text[of] | self.ids_a[start_a[of] + nth_a] << 16 | self.ids_b[start_b[of] + nth_b]]), return_counts=True)
        if not wide.any():
            return keys, times
        found = [(keys, times)]
        for k in np.flatnonzero(wide):
            a, m = np.unique(self.ids_a[start_a[k]:start_a[k] + of_a[k]], return_counts=True)
            b, n = np.unique(self.ids_b[start_b[k]:start_b[k] + of_b[k]], return_counts=True)
            found.append((text[k] | (a[:, None] << 16 | b).ravel(), (m[:, None] * n).ravel()))
        keys, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        np.add.at(out, at, np.concatenate([x[1] for x in found]))
        return keys, out

    def _written(self) -> list[bytes]:
        decimals, width = _decimals()
        last_a, last_b = np.zeros(len(self.ids_a), np.int64), np.zeros(len(self.ids_b), np.int64)
        last_a[self.stops_a - 1], last_b[self.stops_b - 1] = 1 << 16, 2 << 16
        out = np.empty(len(last_a) + len(last_b), "<u8")
        # A group's ids of A come before its ids of B, and behind all of B's before it.
        out[np.arange(len(last_a)) + np.repeat(self.stops_b - self.of_b, self.of_a)] = decimals[last_a | self.ids_a]
        out[np.arange(len(last_b)) + np.repeat(self.stops_a, self.of_b)] = decimals[last_b | self.ids_b]
        characters = out.view(np.uint8)
        whole = characters[characters != 0].tobytes()
        sizes = (within(width[self.ids_a], np.cumsum(self.n_a)) + within(width[self.ids_b], np.cumsum(self.n_b))).tolist()
        # The semicolon behind a text's last group is left out.
        return [whole[end - n:max(end - 1, end - n)] for end, n in zip(accumulate(sizes), sizes)]


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit ids as decimals with a comma, then with a bar, then with a semicolon behind, in eight bytes

    filled up with zeros; and how many bytes an id takes with what is behind it.
    """
    if not _tables:
        ids = [str(i).encode() for i in range(1 << 16)]
        _tables.append((np.array([i + end for end in (b",", b"|", b";") for i in ids], "S8").view("<u8"),
                        np.array([len(i) + 1 for i in ids])))
    return _tables[0]


NOTHING = Aligned(0, 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), b"")


def aligner(vocabulary: str, model: str) -> "Aligner":
    """The worker's aligner for two files; it lives as long as the worker."""
    if (vocabulary, model) not in _aligners:
        _aligners[vocabulary, model] = Aligner(vocabulary, model)
    return _aligners[vocabulary, model]


class Aligner:
    """Aligns a byte-level tokenizers file (A) with a sentencepiece model (B) that puts a space before a text."""

    def __init__(self, vocabulary: str, model: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Encoder(vocabulary, "leading", plain=True)
        self._b = sentencepiece.SentencePieceProcessor(model_file=model)
        tokens, pieces = Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=False), self._b.get_piece_size()
        if max(tokens.values()) >= 1 << 16 or pieces > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        of = byte_level()
        if not all(c in of for token in tokens for c in token if not token.startswith("<|")):
            raise ValueError("not a byte-level vocabulary")
        self._length_a = np.zeros(max(tokens.values()) + 2, np.int64)
        for token, i in tokens.items():
            self._length_a[i] = len(token)
        bytes_b = [
            bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(self._b.id_to_piece(k) for k in range(pieces))]
        self._length_b = np.array([len(x) for x in bytes_b], np.int64)
        self._start_b = np.cumsum(self._length_b) - self._length_b
        self._bytes_b = np.frombuffer(b"".join(bytes_b), np.uint8)

    def align(self, texts: list[str | None]) -> Iterator[Aligned]:
        """The alignment of each text; without tokens it is empty."""
        found = chain.from_iterable(map(self._together, runs([t for t in texts if t])))
        for text in texts:
            yield next(found) if text else NOTHING

    def _spelled(self, ids_b: np.ndarray) -> np.ndarray:
        """The bytes of B's ids, one behind the other."""
        length = self._length_b[ids_b]
        back = self._start_b[ids_b] - (np.cumsum(length) - length)
        return self._bytes_b[np.arange(length.sum()) + np.repeat(back, length)]

    def _together(self, texts: list[str]) -> Run:
        spaced = [f" {t}" for t in texts]
        packed, listed = self._a.encode(spaced), self._b.encode(texts, num_threads=1)
        wholes = [t.encode() for t in spaced]
        n_a, n_b, sizes = (np.array([len(x) for x in of], np.int64) for of in (packed, listed, wholes))
        n_a //= 4
        ids_a = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        ids_b = np.fromiter(chain.from_iterable(listed), np.int64, n_b.sum())
        # A writes every byte as a character of its own, so it loses none; its length tells as much as its bytes.
        right = ((within(self._length_a[ids_a], np.cumsum(n_a)) == sizes)
                 & (within(self._length_b[ids_b], np.cumsum(n_b)) == sizes))
        given = np.frombuffer(b"".join(compress(wholes, right)), np.uint8)
        differs = np.flatnonzero(self._spelled(ids_b[np.repeat(right, n_b)]) != given)
        right[np.flatnonzero(right)[np.searchsorted(np.cumsum(sizes[right]), differs, "right")]] = False
        ids_a, ids_b = ids_a[np.repeat(right, n_a)], ids_b[np.repeat(right, n_b)]
        return Run(ids_a, ids_b, np.cumsum(self._length_a[ids_a]), np.cumsum(self._length_b[ids_b]), n_a * right, n_b * right)


def runs(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of at most ``RUN`` characters, one text at least."""
    out, n = [], 0
    for text in texts:
        if out and n + len(text) > RUN:
            yield out
            out, n = [], 0
        out.append(text)
        n += len(text)
    if out:
        yield out


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def blocks(docs: DataFrame, vocabulary: str, model: str, digest: bool) -> DataFrame:
    """The aligned texts, block by block, stored.

    A row is a text, with the places of its pairs in the block's list (``at``) and
    their links (``times``), both packed; or a block's list itself: ``pair`` and
    ``docs``, in how many of its texts a pair is linked.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = TaskContext.get().partitionId() << 32, aligner(vocabulary, model)
        for batch in slices(batches, "text", BLOCK):
            n, rows, groups = batch.num_rows, [], []
            pairs, times = [], []
            for x in own.align(batch.column("text").to_pylist()):
                rows.append([getattr(x, c) for c in NUMBERS])
                text = x.text()
                groups.append(hashlib.sha256(text.encode()).hexdigest() if digest and x.n_a else text)
                pairs.append(x.pairs)
                times.append(x.times.astype("<u4" if len(x.times) == 0 or x.times.max() < 1 << 32 else "<u8").tobytes())
            listed, at, docs_ = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            bounds = np.cumsum([0, *map(len, pairs)])
            at = at.astype("<u4")
            places = [at[bounds[k]:bounds[k + 1]].tobytes() for k in range(n)]
            ids = batch.column("doc_id")
            nothing = pa.nulls(1, ids.type)
            # The list is the last row of its block.
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n + 1, block)), pa.concat_arrays([ids, nothing]),
                *[pa.array([r[k] for r in rows] + [None], pa.int64()) for k in range(4)],
                pa.array(groups + [None], pa.string()), pa.array(places + [None], pa.binary()),
                pa.array(times + [None], pa.binary()),
                pa.array([None] * n + [listed], pa.list_(pa.int64())), pa.array([None] * n + [docs_], pa.list_(pa.int64())),
            ], names=["block", "doc_id", *NUMBERS, "groups", "at", "times", "pair", "docs"])
            block += 1

    schema = (f"block long, doc_id {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, groups string, at binary, "
              "times binary, pair array<long>, docs array<long>")
    return stored(only(docs, "doc_id", "text").mapInArrow(align, schema), "aligned")


def pair_counts(named: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, highest): ``highest`` marks the largest counts of each A id, ties included."""
    counts = named.groupBy("pair").agg(F.sum("docs").alias("n_docs"))
    ids = counts.select("pair", F.shiftright("pair", 16).alias("a"), F.expr("pair & 65535").alias("b"), "n_docs")
    # An A id has at most as many rows as the other vocabulary has ids.
    return ids.withColumn("highest", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def named_pairs(found: DataFrame) -> DataFrame:
    """(block, place, pair, docs) of the lists of all blocks."""
    lists = found.where("pair IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pair", "docs")).alias("place", "x"))
    return lists.select("block", "place", "x.pair", "x.docs")


def aligned(docs: DataFrame, vocabulary: str, model: str, digest: bool = False) -> DataFrame:
    """One row a document: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``.

    ``n_best`` counts the links whose pair has its A id's highest count, ``count_sum``
    sums the counts over all links, ``groups`` is the ids as ``a1,a2|b1;a3|b2,b3``,
    or with ``digest`` the SHA-256 of that text (still empty for no tokens).
    """
    found = blocks(docs, vocabulary, model, digest)
    named = named_pairs(found)
    counts = pair_counts(named).select("pair", "n_docs", "highest")
    back = named.select("block", "place", "pair").join(counts, "pair").select("block", "place", "n_docs", "highest")
    texts = found.where("pair IS NULL").drop("pair", "docs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, n_best long, count_sum long, groups string"

    def look(rows: pa.Table, counted: pa.Table) -> pa.Table:
        place = counted.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        n[place] = counted.column("n_docs").to_numpy()
        best[place] = counted.column("highest").to_numpy(zero_copy_only=False)
        n_best, sums = [], []
        for at, times in zip(rows.column("at").to_pylist(), rows.column("times").to_pylist(), strict=True):
            at = np.frombuffer(at, "<u4")
            times = np.frombuffer(times, "<u4" if len(times) == 4 * len(at) else "<u8").astype(np.int64)
            n_best.append(int(times[best[at]].sum()))
            sums.append(int((times * n[at]).sum()))
        return pa.Table.from_arrays(
            [rows.column("doc_id"), *[rows.column(c) for c in NUMBERS], pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()),
             rows.column("groups")], names=["doc_id", *NUMBERS, "n_best", "count_sum", "groups"])

    # Both sides come from one stored table, so the second names its key apart.
    counted_ = back.withColumnRenamed("block", "list")
    return texts.groupBy("block").cogroup(counted_.groupBy("list")).applyInArrow(look, schema)


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level and a piece vocabulary over all documents."""
    import public_tokenizers

    out = aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                  public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op12_cross_tokenizer": op12_cross_tokenizer}
SQL: dict[str, str] = {}
