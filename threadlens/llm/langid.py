"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a binary byte-trigram classifier that
tells the languages with a 1 from those with a 0. All classifiers come from one
table of trigram counts by language over every labelled training text. A text's
margins are compared with each codeword by a loss that weights a bit by how far
its classifier separates the languages; the least loss wins. A text whose two
best languages are close, or whose margins lie far from every codeword, is
flagged ``ambiguous``.

Defined results: a null text, an empty one or one without a letter is ``und``
with score 0; so is every text when no labelled row exists; repeated rows are
judged one by one; rows with a null ``lang`` teach nothing; an empty table gives
no rows. Texts are read whole, in chunks of bounded memory.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_training_part, only, slices, table

BITS = 15
FEATURES = 1 << BITS
CHUNK = 1 << 20
#: A text is ambiguous when its best language has less than this share of the weight.
LEAST_SCORE = 0.6

_letter = regex.compile(r"\p{L}")
# Letters and bytes of longer characters stay, anything else is a gap.
_CLASS = np.full(256, 32, np.uint32)
for _b in [*range(97, 123), *range(128, 256)]:
    _CLASS[_b] = _b
for _b in range(65, 91):
    _CLASS[_b] = _b + 32


def trigrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bounds, ids) for each chunk of the texts' bytes.

    ``bounds`` has one more entry than there are texts: text k has the ids from
    ``bounds[k]`` to ``bounds[k + 1]``. Positions without a trigram have id FEATURES.
    """
    texts = pc.utf8_lower(texts.cast(pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = offsets[1:]
    for a in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        b = min(a + CHUNK, int(offsets[-1]))
        low = np.full(b - a + 2, 32, np.uint32)
        part = data[a:min(b + 2, int(offsets[-1]))]
        low[:len(part)] = _CLASS[part]
        gap = (low == 32).view(np.uint8)
        ids = ((low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        ids[gap[:-2] + gap[1:-1] + gap[2:] > 1] = FEATURES
        for back in (1, 2):  # trigrams that would reach into the next text
            at = ends - back
            ids[at[(at >= a) & (at < b)] - a] = FEATURES
        yield np.clip(offsets, a, b) - a, ids


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """±1 codewords of ``n`` languages: all dichotomies for few, else random ones that lie far apart."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        columns = [c for c in itertools.product((-1, 1), repeat=n - 1) if 1 in c or -1 in c]
        columns = [(1, *c) for c in columns if -1 in c]
        return np.array(columns, np.int8).T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if apart > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart
    return best


@dataclass
class Model:
    """Languages, codewords, one weight vector a bit, and the usual margins of the bits."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray, smoothing: float = 0.5) -> "Model":
        """From trigram counts by language (one row each)."""
        share = (counts + smoothing) / (counts + smoothing).sum(1, keepdims=True)
        code = codewords(len(languages))
        weights = np.zeros((code.shape[1], FEATURES + 1))
        for b, column in enumerate(code.T):
            if len(languages) > 1:
                ones, zeros = share[column > 0].mean(0), share[column < 0].mean(0)
                weights[b, :FEATURES] = np.log(ones / zeros)
        margins = share @ weights[:, :FEATURES].T
        return cls(languages, code, weights.astype(np.float32), np.maximum(np.abs(margins).min(0), 1e-6) if len(languages) else np.ones(1))

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The mean margin of each text and bit, and the number of trigrams."""
        sums, n = np.zeros((len(texts), len(self.weights))), np.zeros(len(texts))
        for bounds, ids in trigrams(texts):
            for b, w in enumerate(self.weights):
                total = np.concatenate([[0], np.cumsum(w[ids], dtype=np.float64)])
                sums[:, b] += np.diff(total[bounds])
            n += np.diff(np.concatenate([[0], np.cumsum(ids < FEATURES)])[bounds])
        return sums / np.maximum(n, 1)[:, None], n

    def decode(self, margins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its score, ambiguous) by loss-weighted distance to the codewords.

        A margin counts in units of the least usual one; the loss of a bit is
        logistic and sharpens with the number of trigrams.
        """
        z = margins / self.scale
        weight = self.scale / self.scale.sum()
        sharp = 1 + np.log1p(n)[:, None]
        loss = np.stack([(weight * np.logaddexp(0, -2 * z * c)).sum(1) for c in self.code], 1)
        close = np.exp(-sharp * 4 * (loss - loss.min(1, keepdims=True)))
        share = close / close.sum(1, keepdims=True)
        best = share.argmax(1)
        score = share[np.arange(len(best)), best]
        wrong = ((np.sign(z) * self.code[best]) < 0).sum(1)
        apart = min([int((a != b).sum()) for a, b in itertools.combinations(self.code, 2)], default=99)
        return best, score, (score < LEAST_SCORE) | (wrong > (apart - 1) // 2)


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Counts the trigrams of every row with a language; only the sums (features x languages) reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            names = np.array(batch.column("lang").to_pylist(), object)
            for bounds, ids in trigrams(batch.column("text")):
                owner = np.repeat(np.arange(len(names)), np.diff(bounds))
                for name in set(names[np.unique(owner)]) if len(owner) else ():
                    own = np.bincount(ids[names[owner] == name], minlength=FEATURES + 1)
                    sums[name] = sums.get(name, 0) + own
        for name, n in sums.items():
            at = np.flatnonzero(n[:FEATURES])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                names=["lang", "feature", "n"])

    rows = labelled.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("lang IS NOT NULL")
    counted = rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    languages = sorted(got["lang"].unique())
    counts = np.zeros((len(languages), FEATURES))
    counts[[languages.index(x) for x in got["lang"]], got["feature"].to_numpy(int)] = got["n"]
    return Model.of(languages, counts)


def identified(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` with ``lang_pred, score, ambiguous`` for every row."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    names = [f.name for f in fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x bits: its size does not follow the input

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "_text"):
            texts = batch.column("_text")
            known = np.array([_letter.search(t) is not None for t in texts.to_pylist()], bool)
            if m.languages:
                best, score, doubt = m.decode(*m.margins(texts))
            else:
                best, score, doubt = np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts), bool)
            known &= bool(m.languages)
            guess = [m.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(guess, pa.string()),
                 pa.array(np.where(known, score, 0.0)), pa.array(doubt & known)],
                names=[*names, "lang_pred", "score", "ambiguous"])

    source = docs.select(*[F.col(n) for n in names], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return source.mapInArrow(judge, f"{schema}, lang_pred string, score double, ambiguous boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of the labelled ones."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = fit(docs.where(in_training_part()))
    return identified(docs, model, "doc_id").select(
        "doc_id", (~in_training_part()).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
