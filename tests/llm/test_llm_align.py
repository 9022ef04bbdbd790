"""Cross-tokenizer alignment against whole texts and every byte range."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import sentencepiece
from data import BASE, DOCS, docs, prose
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from threadlens.llm import crosstokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "Bc", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", " \n ", " ", "　", "\x1c", "\x85", "é", "́",
         "ﬁ", "①", "½", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "中文", "🙂", "​", "\0", "'s", "'", "12", "!!",
         "▁", "﻿", "word", "İ"]
RANDOM = ["".join(random.Random(k).choices(PARTS[:-3] if k % 5 else PARTS, k=1 + k % 12)) for k in range(1500)]


OF = crosstokens.byte_level()


def decoded(token):
    return bytes(OF[c] for c in token)


def plain(texts):
    """Per text: ids of both, groups and links, from one call over each whole text and byte ranges."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    out = []
    for text in texts:
        whole = f" {text or ''}".encode()
        ids_a, ids_b = a.encode(f" {text or ''}", add_special_tokens=False).ids, b.encode(text or "")
        of_a = [decoded(a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                for i in ids_b]
        if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
            out.append(([], [], [], []))
            continue
        ends_a, ends_b = list(accumulate(map(len, of_a))), list(accumulate(map(len, of_b)))
        shared = set(ends_b)
        stops = [e for e in ends_a if e in shared]
        groups = [([], []) for _ in stops]
        for side, ids, ends in ((0, ids_a, ends_a), (1, ids_b, ends_b)):
            for i, e in zip(ids, ends, strict=True):
                groups[bisect_left(stops, e)][side].append(i)
        links = [(i, j) for g in groups for i in g[0] for j in g[1]]
        out.append((ids_a, ids_b, groups, links))
    return out


def texts_of(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def expected(rows):
    found = plain([t for _, t in rows])
    docs_with = Counter(p for *_, links in found for p in set(links))
    highest = defaultdict(int)
    for (i, _), n in docs_with.items():
        highest[i] = max(highest[i], n)
    out = []
    for (d, _), (a, b, groups, links) in zip(rows, found, strict=True):
        counts = [docs_with[p] for p in links]
        digest = hashlib.sha256(texts_of(groups).encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), len(groups), len(links),
                    sum(n == highest[i] for (i, _), n in zip(links, counts)), sum(counts), digest))
    return sorted(out, key=str)


def test_byte_level_table_decodes_like_the_library():
    t, of = Tokenizer.from_file(A), crosstokens.byte_level()
    assert len(of) == 256 and sorted(of.values()) == list(range(256))
    for text in ["plain text", "Étion \n\t x", "中🙂"]:
        tokens = t.encode(text, add_special_tokens=False).tokens
        assert b"".join(bytes(of[c] for c in k) for k in tokens).decode() == ByteLevel().decode(tokens) == text


def test_texts_equal_byte_ranges(monkeypatch):
    texts = [*RANDOM, "", " ", "  ", "a ", " a", BASE, prose(300, 9).replace(" ", "  "), "x" * 300, "é́" * 90]
    for wide in (crosstokens.WIDE, 2):
        monkeypatch.setattr(crosstokens, "WIDE", wide)
        own = crosstokens.Aligner(A, B)
        for text, x, (a, b, groups, links) in zip(texts, own.align(texts), plain(texts), strict=True):
            assert (x.n_a, x.n_b, x.n_groups, x.n_links) == (len(a), len(b), len(groups), len(links)), repr(text)
            assert x.text() == texts_of(groups), repr(text)
            assert dict(zip(x.pairs.tolist(), x.times.tolist())) == Counter(i << 16 | j for i, j in links), repr(text)


def test_shared_ends():
    a, b = crosstokens.shared_ends([1, 4, 6, 9], [2, 4, 5, 6, 9])
    assert a.tolist() == [2, 3, 4] and b.tolist() == [2, 4, 5]


def test_texts_are_aligned_together(monkeypatch):
    texts = [*RANDOM[:200], None, "a▁b", BASE, "a▁b", "", "x" * 300, "▁"]
    own, called, once = crosstokens.Aligner(A, B), [], crosstokens.shared_ends
    monkeypatch.setattr(crosstokens, "shared_ends", lambda *ends: called.append(1) or once(*ends))
    have = [(*x[:4], x.pairs.tolist(), x.times.tolist(), x.text()) for x in own.align(texts)]
    assert len(called) == 1
    for run, links, wide in ((1, 1, 1 << 16), (700, 1 << 21, 2), (1 << 18, 50, 1 << 16)):
        for name, value in (("RUN", run), ("LINKS", links), ("WIDE", wide)):
            monkeypatch.setattr(crosstokens, name, value)
        assert [(*x[:4], x.pairs.tolist(), x.times.tolist(), x.text()) for x in own.align(texts)] == have
    for x, (a, b, groups, links) in zip(have, plain(texts), strict=True):
        assert x[:4] == (len(a), len(b), len(groups), len(links)) and x[6] == texts_of(groups)
    assert [x[0] > 0 for x in have[-7:]] == [False, False, True, False, False, True, False]


def test_runs_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(crosstokens, "RUN", 5)
    assert list(crosstokens.runs(["abc", "de", "f", "ghijklm", "n"])) == [["abc", "de"], ["f"], ["ghijklm"], ["n"]]
    assert list(crosstokens.runs([])) == []


def test_query_columns(spark, monkeypatch):
    monkeypatch.setattr(crosstokens, "BLOCK", 700)
    rows = DOCS + list(enumerate(RANDOM[:60], 100)) + [(300, "▁"), (301, "copy"), (301, "copy")]
    out = crosstokens.aligned(docs(spark, rows), A, B).collect()
    have = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum,
             hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in out]
    assert sorted(have, key=str) == expected(rows)


def test_empty_table(spark):
    assert crosstokens.aligned(docs(spark, []), A, B).count() == 0
    assert [tuple(r) for r in crosstokens.aligned(docs(spark, [(1, None), (None, "")]), A, B).orderBy("doc_id").collect()] == [
        (None, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = crosstokens.op12_cross_tokenizer(spark, sf)
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted([tuple(r) for r in df.collect()], key=str) == expected(rows)
