"""A quality classifier: a byte-level convolutional network in numpy.

Filters over four bytes slide over the whole text. Their responses are max-pooled
within chunks of 512 bytes that overlap so that no window is lost; the pooled
vectors of all chunks are averaged and a logistic output gives one probability.

The network is trained on a bounded sample of labelled rows (``most_rows``, drawn
by a hash of the id) and on all chunks of their texts, cut as scoring cuts them, so
that the threshold is set on scores of whole texts. Scoring reads every byte of
every text.

Defined results: a null or empty text has no windows and gets the score of a zero
vector, as any other score in 0 to 1; without a labelled row every score is 0.5;
repeated rows are scored one by one; null labels teach nothing; an empty table
gives no rows. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_training_part, only, slices, table

WIDTH, FILTERS, CHUNK = 4, 16, 512
STRIDE = CHUNK - WIDTH + 1
#: Labelled rows that training sees at most.
MOST_ROWS = 4000
#: Steps that training takes at least, for small samples.
LEAST_STEPS = 300
#: Bytes of text whose responses are in memory at once, and chunks in training.
RUN_BYTES, RUN_CHUNKS = 1 << 20, 512


@dataclass
class Network:
    """``filters`` (width, 256, filters): the weight of a byte at a place of a filter."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float

    @classmethod
    def fresh(cls, seed: int = 11) -> "Network":
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                   rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)

    def paired(self) -> list[np.ndarray]:
        """Tables of the sums for two bytes, so that a window costs two look-ups."""
        return [(self.filters[w][:, None] + self.filters[w + 1][None]).reshape(65536, FILTERS) for w in range(0, WIDTH, 2)]

    def pooled(self, texts: list[bytes], pairs: list[np.ndarray], after: bytes = b"") -> np.ndarray:
        """The mean of the chunks' pooled vectors for each text; the texts fit in memory together.

        ``after`` is what follows a piece in its text, zeros at the end of one.
        """
        gap = after.ljust(WIDTH - 1, b"\0")[:WIDTH - 1]
        lengths = np.array([len(t) for t in texts])
        data = np.frombuffer(gap.join([*texts, b""]) + b"\0" * (WIDTH - 1), np.uint8)
        begins = np.concatenate([[0], np.cumsum(lengths + WIDTH - 1)[:-1]])
        two = data[:-1].astype(np.intp) << 8 | data[1:]
        n = int((lengths + WIDTH - 1).sum()) - (WIDTH - 1)
        total = np.zeros((len(texts), FILTERS), np.float64)
        chunks = np.maximum(1, -(-lengths // STRIDE))
        owner = np.repeat(np.arange(len(texts)), chunks)
        starts = np.repeat(begins, chunks) + (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * STRIDE
        filled = lengths[owner] > 0
        if filled.any():
            response = pairs[0][two[:n]]
            response += pairs[1][two[2:n + 2]]
            for back in range(WIDTH - 1):  # windows that start in a gap
                at = begins + lengths + back
                response[at[at < n]] = -np.inf
            best = np.maximum.reduceat(response, starts[filled], axis=0) + self.bias
            np.add.at(total, owner[filled], np.maximum(best, 0))
        return total / chunks[:, None]

    def pooled_whole(self, text: bytes, pairs: list[np.ndarray]) -> np.ndarray:
        """The pooled vector of one text, read in pieces that overlap like chunks."""
        step, parts, weights = RUN_BYTES // STRIDE * STRIDE, [], []
        for a in range(0, max(1, len(text)), step):
            piece = text[a:a + step]
            parts.append(self.pooled([piece], pairs, text[a + step:a + step + WIDTH - 1])[0])
            weights.append(max(1, -(-len(piece) // STRIDE)))
        return np.average(parts, axis=0, weights=weights)

    def scores(self, texts: list[bytes], pairs: list[np.ndarray]) -> np.ndarray:
        """A probability for each text; long ones are read in pieces that overlap like chunks."""
        out = np.zeros((len(texts), FILTERS))
        group: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            if len(t) > RUN_BYTES:
                out[k] = self.pooled_whole(t, pairs)
                continue
            if group and size + len(t) > RUN_BYTES:
                out[group] = self.pooled([texts[g] for g in group], pairs)
                group, size = [], 0
            group.append(k)
            size += len(t)
        if group:
            out[group] = self.pooled([texts[g] for g in group], pairs)
        return 1 / (1 + np.exp(-np.clip(out @ self.out + self.shift, -30, 30)))


def trained(bags: list[list[bytes]], labels: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.02, seed: int = 5,
            decide_at: float = 0.3) -> Network:
    """Fits the network to texts given as chunks (at most CHUNK bytes each), by Adam on the log loss.

    Scores are shifted so that ``decide_at`` separates the sample's labels best.
    """
    net, rng = Network.fresh(), np.random.default_rng(seed)
    if not len(bags):
        net.out[:] = 0
        return net
    params = [net.filters, net.bias, net.out, np.array([net.shift], np.float32)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    width = CHUNK + WIDTH - 1
    rows = np.zeros((sum(map(len, bags)), width), np.uint8)
    valid = np.zeros(len(rows), np.int64)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    for k, c in enumerate(c for b in bags for c in b):
        rows[k, :len(c)] = np.frombuffer(c, np.uint8)
        valid[k] = min(len(c), STRIDE)
    begins = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(bags)))
    params[3][0] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    places = np.arange(CHUNK)
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for lo in range(0, len(order), batch):
            docs = order[lo:lo + batch]
            use = np.concatenate([np.arange(begins[d], begins[d + 1]) for d in docs])
            local = np.searchsorted(np.sort(docs), owner[use])
            rank = np.sort(docs)
            x = rows[use]
            best, top = np.zeros((len(use), FILTERS), np.int64), np.zeros((len(use), FILTERS), np.float32)
            for a in range(0, len(use), RUN_CHUNKS):
                run = slice(a, a + RUN_CHUNKS)
                response = sum(params[0][w][x[run, w:w + CHUNK]] for w in range(WIDTH))
                response[places[None] >= valid[use[run]][:, None]] = -np.inf
                best[run] = response.argmax(1)
                top[run] = np.take_along_axis(response, best[run][:, None], 1)[:, 0] + params[1]
            h = np.maximum(np.where(np.isfinite(top), top, 0), 0)
            n = np.bincount(local, minlength=len(rank))
            mean = np.stack([np.bincount(local, h[:, f], len(rank)) for f in range(FILTERS)], 1) / n[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ params[2] + params[3][0], -30, 30)))
            err = (p - labels[rank]) / len(rank)
            back = (err / n)[local][:, None] * params[2] * (h > 0)
            grads = [np.zeros_like(q) for q in params]
            for w in range(WIDTH):
                np.add.at(grads[0][w], (np.take_along_axis(x, best + w, 1), np.arange(FILTERS)[None].repeat(len(x), 0)), back)
            grads[1], grads[2], grads[3] = back.sum(0), err @ mean, np.array([err.sum()])
            t += 1
            for q, g, a, b, decay in zip(params, grads, first, second, (1e-4, 0, 1e-3, 0), strict=True):
                g = g + decay * q
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= (step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net.filters, net.bias, net.out, net.shift = params[0], params[1], params[2], float(params[3][0])
    net.shift += _moved_threshold(net, bags, labels, decide_at)
    return net


def _moved_threshold(net: Network, bags: list[list[bytes]], labels: np.ndarray, decide_at: float) -> float:
    """What to add to the logit so that ``decide_at`` is where fewest sample rows are judged wrong."""
    pairs = net.paired()
    # A chunk's own windows end where the next chunk begins, so the chunks join to the text.
    pooled = [net.pooled_whole(b"".join([*[c[:STRIDE] for c in bag[:-1]], bag[-1]]), pairs) for bag in bags]
    logit = np.array(pooled) @ net.out + net.shift
    order = np.argsort(logit)
    wrong = np.concatenate([[0], np.cumsum(labels[order] == 1)]) + np.concatenate([np.cumsum((labels[order] == 0)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    edges = logit[order]
    cut = (edges[max(0, k - 1)] + edges[min(k, len(edges) - 1)]) / 2
    return float(np.clip(np.log(decide_at / (1 - decide_at)) - cut, -4, 4))


def chunks(data: bytes) -> list[bytes]:
    """All chunks of a text as scoring cuts it; one at least. Neighbours share ``WIDTH - 1`` bytes."""
    return [data[a:a + CHUNK] for a in range(0, max(1, len(data)), STRIDE)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Network:
    """The network for ``docs`` (doc_id, text) and ``labels`` (doc_id, 0 or 1); at most ``most_rows`` labelled rows are used."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)
    # The sample's ids are bounded by ``most_rows``.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bags = [chunks(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(bags, pa.list_(pa.binary()))], names=["doc_id", "y", "bag"])

    got = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(
        chunked, "doc_id long, y int, bag array<binary>").orderBy("doc_id", "y").limit(most_rows).collect()
    return trained([[bytes(c) for c in r.bag] for r in got], np.array([r.y for r in got], float))


def scored(docs: DataFrame, net: Network, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` and ``score`` for every row."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = [f.name for f in fields]
    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 64 KB

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value.paired()
        for batch in slices(batches, "_text"):
            score = shared.value.scores([t.encode() for t in batch.column("_text").to_pylist()], pairs)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(score)], names=[*names, "score"])

    source = docs.select(*[F.col(n) for n in names], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return source.mapInArrow(rate, f"{columns}score double")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labelled rows outside the held-out fifth."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = only(table(spark, sf_dir, "labels"), "doc_id", "quality").where(in_training_part())
    return scored(docs, fit(docs, labels), "doc_id").select(
        "doc_id", (~in_training_part()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
SQL: dict[str, str] = {}
