"""The pipeline, stage by stage, against brute force."""

import zlib

import numpy as np
import public_tokenizers
from data import DOCS, prose
from test_llm_join import brute
from test_llm_text import brute_spans
from tokenizers import Tokenizer

import corpus_pipeline as cp
from threadlens.llm import decontaminate, packing, pii
from threadlens.llm.common import stored

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "pii", "packing"]
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in cp.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), name))
    raw, language, join, clean, masked, packed = [t.collect() for t in tables]
    assert all(sorted(t.columns) == sorted(cp.COLUMNS) for t in tables[:5])

    texts = {r.doc_id: r.text for r in raw}
    gone = {r.doc_id for r in raw} - {r.doc_id for r in language}
    assert all(len((texts[d] or "").split()) < 4 for d in gone)
    assert np.mean([r.lang == o.lang for r, o in zip(sorted(language), sorted(r for r in raw if r.doc_id not in gone), strict=True)]) > 0.98

    classes = brute([(r.doc_id, r.text) for r in language])
    assert {r.doc_id for r in join} == {d for d, _, c, _ in classes if d == c} < {d for d, *_ in classes}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    block = decontaminate.Block(items)
    hits = dict(zip([r.doc_id for r in join], block.overlaps([r.text for r in join]), strict=True))
    assert {r.doc_id for r in clean} == {d for d, found in hits.items() if not found}
    holders = {r.doc_id for r in join if any(t.lower() in r.text.lower() for _, t in items)}
    assert holders and not holders & {r.doc_id for r in clean}

    before = {r.doc_id: r.text for r in clean}
    take = frozenset(pii.accepted(pii.found(tables[3])))
    for r in masked:
        assert r.text == pii.masked(before[r.doc_id], take) and r.n_chars == len(r.text)
        assert not brute_spans(r.text)
        if not brute_spans(before[r.doc_id]) and not pii.candidates(before[r.doc_id], []):
            assert r.text == before[r.doc_id]

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for r in masked:
        ids = np.array([*model.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want |= {(r.doc_id, s, n, zlib.crc32(ids[s:s + n].tobytes()), len(ids)) for s, n in packing.cuts(len(ids))}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed} == want


def test_odd_rows_pass_every_stage(spark):
    rows = [(d, t, None if k % 3 else "en", None, None) for k, (d, t) in enumerate(DOCS)]
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS score", "'x' AS items", "'x' AS component_id")
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert sorted(docs.columns) == sorted(cp.COLUMNS) and docs.filter("text IS NULL").count() == 0
    kept = [r.doc_id for r in docs.filter("start = 0").collect()]
    assert kept.count(5) == 1 and 6 not in kept and 4 in kept


def test_one_row_of_each_group_stays(spark):
    """Rows without an id are copies like others, and a repeated id does not keep another row of that id."""
    a, b, c, d = (prose(60, k) for k in range(4))
    rows = [(1, a), (None, a), (None, a + " tail"), (None, b), (None, b), (None, b + " tail"), (2, c), (3, a), (3, d), (3, d), (7, ""), (None, ""), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", "x", None) for k, t in rows], COLUMNS)
    have = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect()]
    b_kept = [t for i, t in have if i is None and t]
    assert len(b_kept) == 1 and b_kept[0].startswith(b)
    assert sorted((x for x in have if x[1] not in b_kept), key=str) == sorted([(1, a), (2, c), (3, d), (7, ""), (None, ""), (None, "")], key=str)


def test_empty_table_passes_every_stage(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0
