"""A training corpus from raw documents, stage by stage.

Each stage takes the documents that its predecessor kept and is written as Parquet
before the next one reads it:

1. language ID: texts without a letter and ambiguous ones go, ``lang`` becomes the
   predicted language;
2. n-gram Jaccard join: of each group of linked rows one stays, that of the
   smallest id (one without an id only where none has any);
3. benchmark decontamination: texts that overlap with a benchmark item go;
4. PII: found spans are replaced by their kind, ``n_chars`` follows;
5. packing: the ids of what is left, as sequences of binary lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import decontaminate, langid, ngram_join, packing, pii
from threadlens.llm.common import in_training_part, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language."""
    model = langid.fit(docs.where(in_training_part()).select("text", "lang"))
    judged = langid.identified(docs.select(*COLUMNS), model, *COLUMNS)
    kept = judged.where("lang_pred <> 'und' AND NOT ambiguous")
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: of the smallest id, rows without an id last."""
    # Rows of one key are equal in every column; nulls are told apart, which the hash skips.
    key = F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])
    docs = docs.select(*COLUMNS, key.alias("_key"))
    classes = ngram_join.linked(docs, "_key").groupBy(F.col("doc_id").alias("_key")).agg(
        F.min("component_id").alias("class"), F.count(F.when(F.col("n_shingles") > 0, 1)).alias("rows"))
    ids = docs.groupBy("_key").agg(F.min("doc_id").alias("id"))
    first = ids.join(classes, "_key").groupBy("class").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_key", "rows")).alias("first"))
    kept = stored(first.select("first._key", "first.rows"), "kept")
    # Most rows are kept: too many keys to broadcast, at any size. Wordless rows are not linked and all stay.
    once = docs.hint("merge").join(kept.where("rows < 2").select("_key").hint("merge"), "_key", "left_semi")
    repeated = docs.join(kept.where("rows > 1").select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
    return once.unionByName(repeated).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.matched(docs.select(*COLUMNS), items, *COLUMNS).where(F.size("items") == 0).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced."""
    docs = docs.select(*COLUMNS)
    take = pii.accepted(pii.found(docs))
    return pii.redacted(docs, take).withColumn("n_chars", F.length("text").cast("long"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    import public_tokenizers

    return packing.digest(packing.packed(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", packed_sequences),
]

#: Tokenizers, trained classifiers and text hashes are not SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
