"""Token counts through the digest cache, against the tokenizers library."""

import public_tokenizers
import pytest
from data import BASE, DOCS, LONG, docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadlens.llm import tokencount
from threadlens.llm.common import shared_folder, stored

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a  B", "A b", "x \n y", "Σας ΣΑΣ a\x1cb", "É É İ i̇", "it's 'S OK <|endoftext|> z",
       "<|ENDOFTEXT|> A", "<|startoftext|>\n\n<|endoftext|>", "a B　c", "nul \0 nul", "q" * 500 + " X",
       "tab\tb \t c\x0b\x0c\r", "1234 ½ ① ǅ", "​ ́a", BASE, BASE.upper(), LONG]


def plain(rows):
    t = Tokenizer.from_file(PATH)
    n = [len(e.ids) for e in t.encode_batch([text or "" for _, text in rows], add_special_tokens=False)]
    return sorted([(d, len((text or "").encode()), k, k > 2048) for (d, text), k in zip(rows, n, strict=True)], key=str)


def have(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()], key=str)


def cached(spark, cache):
    return spark.read.schema(tokencount.CACHE).parquet(cache)


def test_counts_equal_the_library(spark):
    rows = DOCS + list(enumerate(ODD, 100))
    assert have(tokencount.counted(docs(spark, rows), PATH, shared_folder(spark, "cache"))) == plain(rows)


def test_only_distinct_misses_are_encoded(spark, monkeypatch):
    cache = shared_folder(spark, "cache")
    assert have(tokencount.counted(docs(spark), PATH, cache)) == plain(DOCS)
    first = cached(spark, cache).count()
    assert first == cached(spark, cache).select("digest").distinct().count() < len(DOCS)  # copies share an entry
    # A second run over the same texts, and more, encodes the new ones alone.
    more = DOCS + [(200, "a new text"), (201, " A  NEW\ntext "), (202, BASE)]
    assert have(tokencount.counted(docs(spark, more), PATH, cache)) == plain(more)
    assert cached(spark, cache).count() == first + 1
    # What the cache holds is taken as it is: a changed entry shows.
    wrong = tokencount.content_digest
    digest = spark.createDataFrame([("fresh words",)], "text string").select(wrong("text").alias("d")).first().d
    spark.createDataFrame([(tokencount.tokenizer_digest(PATH), digest, 77)], tokencount.CACHE).write.mode(
        "append").partitionBy("tokenizer").parquet(cache)
    assert have(tokencount.counted(docs(spark, [(1, "Fresh  words")]), PATH, cache)) == [(1, 12, 77, False)]
    assert have(tokencount.counted(docs(spark, [(1, "Fresh  words")]), PATH, shared_folder(spark, "cache"))) == [
        (1, 12, 2, False)]


def test_repeated_appends_and_other_tokenizers(spark):
    cache = shared_folder(spark, "cache")
    tokencount.counted(docs(spark), PATH, cache).count()
    rows = cached(spark, cache)
    again = rows.unionByName(rows.withColumns({"tokenizer": F.lit("other"), "n_tokens": F.lit(999).cast("long")}))
    stored(again, "again").write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert have(tokencount.counted(docs(spark), PATH, cache)) == plain(DOCS)


@pytest.mark.parametrize("few", [0, 100_000])
def test_many_and_few_misses_agree(spark, monkeypatch, few):
    monkeypatch.setattr(tokencount, "FEW", few)
    assert have(tokencount.counted(docs(spark), PATH, shared_folder(spark, "cache"), 2048)) == plain(DOCS)


def test_empty_table(spark):
    cache = shared_folder(spark, "cache")
    assert tokencount.counted(docs(spark, []), PATH, cache).count() == 0
    assert have(tokencount.counted(docs(spark, [(1, "a")]), PATH, cache)) == [(1, 1, 1, False)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = tokencount.op11_token_counts(spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert have(df) == plain(rows)
