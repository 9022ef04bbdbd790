"""Token ids, token files and packing against the tokenizers library."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from data import BASE, DOCS, LONG, docs
from tokenizers import Tokenizer
from tokenizers.normalizers import Replace
from tokenizers.pre_tokenizers import ByteLevel, Digits, Sequence, Whitespace

from threadlens.llm import packing, tokenfile
from threadlens.llm.tokens import Encoder

ODD = ["", " ", "a  b", "x \n y", "\n\n a b ", "Σας ΣΑΣ a\x1cb", "é ́x", "it's 's ok <|endoftext|> z", "a b 　c",
       "nul \0 nul", "q" * 500 + " x", "tab\tb \t c", BASE]


def plain(name, texts, end=2):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*e.ids, end], "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name, cut", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")])
def test_cut_texts_have_the_same_ids(name, cut):
    encoder = Encoder(public_tokenizers.path(name), cut)
    assert encoder.encode(ODD, 2) == plain(name, ODD)
    assert encoder.encode(ODD, 2) == plain(name, ODD)  # from memory


@pytest.mark.parametrize("name, cut", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")])
def test_words_go_straight_to_the_merges(name, cut):
    encoder, r = Encoder(public_tokenizers.path(name), cut), np.random.default_rng(5)
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    words = ["Señor, señor!", " ".join(f"a{c}a.,;:\nThe" for c in letters), "x###\nY%%%\nz$$$", "Ünder_score-d@[a]{b}`c`~"]
    want = plain(name, words)
    library, encoder._tokenizer = encoder._tokenizer, None  # the whole library is not asked
    assert encoder.encode(words, 2) == want
    encoder._tokenizer = library
    # Anything else beside them, in any order.
    pool = [*"abStéÜßµªº×÷", *" \n\t'.,!?<|>_09\u0301\u212a中", "'s", "'LL", " the", "<|endoftext|>", ".\nThe", "\n\n"]
    texts = ["".join(r.choice(pool, n)) for n in r.integers(1, 30, 4000)]
    assert encoder.encode(texts, 2) == plain(name, texts)


def test_other_vocabularies_ask_the_whole_library(tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.pre_tokenizer = Sequence([Whitespace(), ByteLevel(add_prefix_space=False, use_regex=False), Digits()])
    t.normalizer = Replace("a", "b")
    t.save(path := f"{tmp_path}/other.json")
    texts = ["Banana, (and). x-y", "a.b"]
    assert Encoder(path, "dropped").encode(texts) == [
        np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_file_query(spark):
    back = tokenfile.read(tokenfile.write(docs(spark), public_tokenizers.path("byte_bpe_50k.json"))).collect()
    ids = dict(zip([t for _, t in DOCS], plain("byte_bpe_50k.json", [t or "" for _, t in DOCS]), strict=True))
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in back) == sorted((str(d), ids[t]) for d, t in DOCS)
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4
    order = [r.doc_id for r in sorted(back, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_empty_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokenfile.read(tokenfile.write(docs(spark, []), path)).count() == 0
    assert packing.packed(docs(spark, []), path).count() == 0


class Kept(io.BytesIO):
    def close(self):
        self.content = self.getvalue()


def test_frames_stand_alone():
    out, r = Kept(), np.random.default_rng(2)
    texts = [r.integers(0, 900, n).astype("<u4").tobytes() for n in [5, 0, 400, 3, 9000, 1, 1, 700]]
    writer = tokenfile.Writer(out, frame_bytes=2000)
    for k, t in enumerate(texts):
        writer.add(None if k == 3 else 10 * k, t)
    writer.close()
    reader = tokenfile.Reader(io.BytesIO(out.content))
    assert [t for _, _, t in reader.documents()] == texts
    assert reader.doc_ids == [0, 10, 20, None, 40, 50, 60, 70]
    only = tokenfile.Reader(io.BytesIO(out.content))
    assert [t for _, _, t in only.documents([2])] == [texts[2]] and only.decompressed == 1
    # Any zstandard reader sees one stream of frames; skippable ones hold no content.
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.content), read_across_frames=True).read()
    assert plain == b"".join(texts)
    broken = bytearray(out.content)
    broken[-10] ^= 1  # a checksum in the seek table
    with pytest.raises(ValueError):
        list(tokenfile.Reader(io.BytesIO(bytes(broken))).documents())


def test_no_documents():
    out = Kept()
    tokenfile.Writer(out).close()
    assert list(tokenfile.Reader(io.BytesIO(out.content)).documents()) == []


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 12345])
def test_cuts_are_binary_and_gapless(n):
    at = 0
    for start, length in packing.cuts(n):
        assert start == at and length & (length - 1) == 0 and 0 < length <= 4096
        at += length
    assert at == n
    assert len(packing.cuts(n)) == n // 4096 + (n % 4096).bit_count()


def test_packing_query(spark):
    rows = packing.digest(packing.packed(docs(spark), public_tokenizers.path("word_bpe_49k.json"))).collect()
    want = []
    for (d, _), ids in zip(DOCS, plain("word_bpe_49k.json", [t or "" for _, t in DOCS]), strict=True):
        n = len(ids) // 4
        want += [(d, s, m, zlib.crc32(ids[4 * s:4 * (s + m)]), n, 0) for s, m in packing.cuts(n)]
    have = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in rows]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert max(r.length for r in rows if r.doc_tokens > len(LONG) // 20) == 4096
