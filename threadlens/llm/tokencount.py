"""Token counts through a digest cache.

The cache is a table of (tokenizer digest, content digest, n_tokens). Content is
normalised before it is hashed, so texts that differ only in white space or, as a
rule, in ASCII case share one entry. A run looks its distinct digests up, encodes
one text for each digest that is missing, and appends those counts. An entry is a
function of its two digests: a repeated append, an append of half a job or two jobs
at once leave only right rows, and readers fold repeated ones.

The tokenizer digest covers the vocabulary file, the library's version and the form
of normalisation, so another tokenizer never reads these counts.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty table
gives no rows and appends nothing; repeated rows and null ids come back once a row.
Further input columns are left out. Texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, exists, only, shared_folder, slices, stored, table
from .tokens import encoder

LIMIT = 2048
#: So many missing digests of 32 bytes at most are broadcast, to read only their texts.
FEW = 100_000
#: Named in the tokenizer digest; changes with :func:`normalised`.
FORM = "white space runs to one space, trimmed, A-Z lowered without <|, v1"
CACHE = "tokenizer string, digest binary, n_tokens long"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text as far as a vocabulary that lowers letters and drops white space sees it.

    Strings of special tokens are matched before the tokenizer lowers anything, so
    texts that may hold one keep their case.
    """
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(spaced.contains("<|"), spaced).otherwise(F.translate(spaced, UPPER, LOWER))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def tokenizer_digest(vocabulary: str) -> str:
    with open(vocabulary, "rb") as f:
        content = hashlib.sha256(f.read())
    content.update(f"\0{version('tokenizers')}\0{FORM}".encode())
    return content.hexdigest()


def entries(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """One row a content digest that the cache holds for this tokenizer."""
    if not exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(docs: DataFrame, misses: DataFrame, vocabulary: str) -> DataFrame:
    """(digest, n_tokens) of the missing digests, each from one of its texts."""
    texts = docs.select(content_digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("text"))
    if misses.count() <= FEW:
        one = texts.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
    else:
        # Copies are folded before the shuffle; the join then finds both sides dealt by digest.
        one = texts.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary, "dropped")
        for batch in slices(batches, "text", 4 << 20):
            n = np.array([len(ids) // 4 for ids in model.encode(batch.column("text").to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n)], names=["digest", "n_tokens"])

    return one.select("digest", "text").mapInArrow(count, "digest binary, n_tokens long")


def counted(docs: DataFrame, vocabulary: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of each row of ``docs`` (``doc_id``, ``text``).

    ``vocabulary`` is a tokenizers file whose tokenizer drops white space and lowers
    letters; ``cache`` is a folder that later runs name again.
    """
    spark, tokenizer = docs.sparkSession, tokenizer_digest(vocabulary)
    docs = only(docs, "doc_id", "text")
    keyed = stored(docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        content_digest(F.col("text")).alias("digest")), "count-keys")
    looked = stored(
        keyed.select("digest").distinct().join(entries(spark, cache, tokenizer), "digest", "left"), "count-looked")
    fresh = stored(encoded(docs, looked.where("n_tokens IS NULL").select("digest"), vocabulary), "count-fresh")
    fresh.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    known = looked.where("n_tokens IS NOT NULL").unionByName(fresh)
    return keyed.join(known, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; ``spark.threadlens.tokenCache`` names a cache that outlives the run."""
    import public_tokenizers

    cache = spark.conf.get("spark.threadlens.tokenCache", None) or shared_folder(spark, "token-cache")
    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)


QUERIES = {"op11_token_counts": op11_token_counts}
SQL: dict[str, str] = {}
