"""Benchmark decontamination with spaced seeds.

A seed is a mask over consecutive words: words at its ones are hashed, words at
its zeros may differ. The hashes of all benchmark items are joined with those at
every word of every text; each hit fixes how text and item lie against each
other, and the overlap around it is compared word by word. The overlap counts
when the best-scoring stretch (+1 for an equal word, -1 for another) has at least
``enough`` equal words, see :func:`enough`. A text with such an overlap is contaminated.

The benchmark is read in blocks of a bounded number of words, each broadcast in
turn over all texts; no text is shuffled and no hit is dropped.

Defined results: null, empty and wordless texts or items never match; repeated
rows are judged one by one; an empty benchmark or table leaves all rows clean;
items shorter than a mask must occur whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, slices, table
from .words import hashed, joined, placed, summed

#: The masks: six words are looked at, up to six are ignored.
MASKS = ("111111", "11101101", "1101100011", "110010001011")
#: Words of benchmark text that one block holds; a longer item has a block of its own.
BLOCK_WORDS = 1_000_000
#: Equal seeds that are laid out at once.
_EXPANDED = 1 << 20
_FILTER_BITS = 20
#: Words of consecutive texts that are hashed together.
RUN_WORDS = 1 << 15

# Words are runs of letters and digits; case and ASCII punctuation do not count.
_GAPS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def split(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_GAPS).split()


def enough(n: int) -> int:
    """Equal words that an overlap with an item of ``n`` words needs: 13, less for short items."""
    return min(13, max(min(n, 10), (n + 1) // 2))


class Block:
    """Seeds of some items, sorted by hash, with a bit table that rules most positions out."""

    def __init__(self, items: list[tuple[int, str]], masks=MASKS):
        self.ids = [i for i, _ in items]
        self.words = [hashed(split(t or "")) for _, t in items]
        shapes = [tuple(k for k, c in enumerate(m) if c == "1") for m in masks]
        shapes = [(s, s[-1] + 1) for s in shapes]
        shortest = min(span for _, span in shapes)
        # Items below the shortest mask are looked up whole, one shape a length.
        whole = [(tuple(range(n)), n) for n in sorted({len(w) for w in self.words if 0 < len(w) < shortest})]
        self.shapes = shapes + whole
        self.seeds = []
        for shape, span in self.shapes:
            hs, item, at = [], [], []
            for k, w in enumerate(self.words):
                if len(w) >= span and (span >= shortest or len(w) == span):
                    n = len(w) - span + 1
                    hs.append(joined(w, shape, n))
                    item.append(np.full(n, k))
                    at.append(np.arange(n))
            h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            pick = lambda parts: (np.concatenate(parts) if parts else np.zeros(0, np.int64))[order]
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[h >> np.uint64(64 - _FILTER_BITS)] = True
            self.seeds.append((h[order], pick(item), pick(at), bits))

    def overlaps(self, texts: list[str | None]) -> list[dict[int, int]]:
        """For each text the ids of items that overlap with it, each with the most equal words."""
        found: list[dict[int, int]] = [{} for _ in texts]
        first, words = 0, []
        for k, t in enumerate(texts):
            words.append(split(t or ""))
            if k + 1 == len(texts) or sum(map(len, words)) >= RUN_WORDS:
                self._look(words, found[first:k + 1])
                first, words = k + 1, []
        return found

    def _look(self, words: list[list[bytes]], found: list[dict[int, int]]) -> None:
        w = hashed([x for own in words for x in own])
        ends = np.cumsum([len(own) for own in words])
        products, seen = placed(w, max(len(shape) for shape, _ in self.shapes)) if self.shapes else [], set()
        for (shape, span), (seeds, items, places, bits) in zip(self.shapes, self.seeds, strict=True):
            if len(w) < span or not len(seeds):
                continue
            h = summed(products, shape, len(w) - span + 1)
            maybe = np.flatnonzero(bits[h >> np.uint64(64 - _FILTER_BITS)])
            lows, highs = np.searchsorted(seeds, h[maybe], "left"), np.searchsorted(seeds, h[maybe], "right")
            # Equal seeds on one diagonal are one candidate: a repeated word gives as many as it has shifts.
            for text, item, shift in self._diagonals(maybe, lows, highs, items, places, ends):
                if (text, item, shift) not in seen:
                    seen.add((text, item, shift))
                    start = int(ends[text - 1]) if text else 0
                    n = self._equal_words(w[start:ends[text]], item, shift)
                    if n >= enough(len(self.words[item])):
                        found[text][self.ids[item]] = max(found[text].get(self.ids[item], 0), n)

    @staticmethod
    def _diagonals(at: np.ndarray, lows: np.ndarray, highs: np.ndarray, items: np.ndarray, places: np.ndarray,
                   ends: np.ndarray) -> list[tuple[int, int, int]]:
        """The distinct (text, item, shift) of equal seeds; ``lows`` to ``highs`` are the seeds that equal place ``at``."""
        at, lows, n = at[highs > lows], lows[highs > lows], (highs - lows)[highs > lows]
        # A hit that reaches into the next text has no such stretch in its own.
        text = np.searchsorted(ends, at, "right")
        local = at - np.where(text > 0, ends[text - 1], 0)
        parts: list[np.ndarray] = []
        first = 0
        sums = np.cumsum(n)
        while first < len(at):
            done = sums[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sums, done + _EXPANDED, "right")))
            own = n[first:last]
            seed = np.repeat(lows[first:last] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            rows = np.stack([np.repeat(text[first:last], own), items[seed],
                             np.repeat(local[first:last], own) - places[seed]]).astype(np.int64)
            order = np.lexsort(rows[::-1])
            rows = rows[:, order]
            new = np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)]) if rows.shape[1] else np.zeros(0, bool)
            parts.append(rows[:, new])
            first = last
        return [tuple(r) for p in parts for r in p.T.tolist()]

    def _equal_words(self, w: np.ndarray, item: int, shift: int) -> int:
        """Equal words in the best stretch of the item laid at word ``shift`` of the text."""
        own = self.words[item]
        lo, hi = max(0, -shift), min(len(own), len(w) - shift)
        if hi <= lo:
            return 0
        same = own[lo:hi] == w[lo + shift:hi + shift]
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -1))])
        lead = total - np.minimum.accumulate(total)
        end = int(lead.argmax())
        start = end - int((total[:end + 1][::-1]).argmin())
        return int(same[start:end].sum())


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items in blocks; the driver holds one block at a time."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    items, n = [], 0
    for r in rows.toLocalIterator():
        size = len(split(r.t or ""))
        if items and n + size > most_words:
            yield Block(items)
            items, n = [], 0
        items.append((r.i, r.t))
        n += size
    if items:
        yield Block(items)


def matched(docs: DataFrame, benchmark: DataFrame, *keep: str, text: str = "text", item_id: str = "item_id",
            most_words: int = BLOCK_WORDS) -> DataFrame:
    """``keep`` with ``items`` (ids, ascending) and ``equal_words`` (the most) for every row."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = [f.name for f in fields]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    found = docs.select(
        *[F.col(n) for n in names], F.col(text).cast("string").alias("_text"),
        F.array().cast("array<long>").alias("items"), F.lit(0).cast("long").alias("equal_words"))

    def look(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in slices(batches, "_text"):
                items, most = batch.column("items").to_pylist(), batch.column("equal_words").to_pylist()
                for k, got in enumerate(block.overlaps(batch.column("_text").to_pylist())):
                    if got:
                        items[k], most[k] = sorted({*items[k], *got}), max(most[k], *got.values())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in names], batch.column("_text"),
                     pa.array(items, pa.list_(pa.int64())), pa.array(most, pa.int64())],
                    names=[*names, "_text", "items", "equal_words"])
        return run

    for block in blocks(benchmark, item_id=item_id, most_words=most_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most ``most_words`` words and the bit tables
        found = found.mapInArrow(look(shared), f"{columns}, _text string, items array<long>, equal_words long")
    return found.drop("_text") if "_text" not in names else found


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it contains."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    items = only(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return matched(docs, items, "doc_id").select(
        "doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"),
        "items", "equal_words")


QUERIES = {"op7_decontamination": op7_decontamination}
SQL: dict[str, str] = {}
