"""Rules, personal data, language, quality and decontamination on small tables."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from data import BASE, DOCS, LONG, docs, prose

from threadlens.llm import bytecnn, decontaminate, langid, pii, rules


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_rules_by_brute_force(spark):
    repeated = DOCS + [(20, "a b c d e f g h a b c d e f g h i"), (21, "x " * 30), (22, "l one\nl one\n\n \nl two\nl one"), (23, "# * | <b> && $ % a")]
    have = {}
    for r in rules.judged(docs(spark, repeated), "doc_id", "text").collect():
        have[r.doc_id, r.text] = r
    for d, t in repeated:
        r, w = have[d, t], words(t)
        windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 2000 else set()
        covered = {k + o for k, x in enumerate(windows) if x in twice for o in range(8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_lines, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(lines), len(lines) - len(set(lines)), len(covered)), (d, t and t[:50])
        assert r.n_symbols == sum(c in rules.SYMBOLS for c in t or "")
        assert r.kept == (not r.failed) and ("n_words" in r.failed) == (len(w) < 20)


def test_rules_need_no_python(spark):
    plan = rules.judged(spark.range(3).selectExpr("id AS doc_id", "cast(id AS string) AS text"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_thresholds_are_a_table(spark):
    strict = (rules.Threshold("n_words", most=3),)
    kept = {r.doc_id for r in rules.judged(docs(spark, [(1, "a b c"), (2, "a b c d")]), "doc_id", thresholds=strict).collect() if r.kept}
    assert kept == {1}


PERSONAL = [
    "a.b+c@d-e.f.org, x@y @z.w q@r.s", "1.2.3.4 1.2.3.4.5 300.1.1.1 01.002.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 123-4567 or +123 or + 1", "call +49 30 1234567 12, card 378282246310005", "9" * 5000 + ".1.1.1 a@" + "b" * 3000,
    "é 4111111111111111", "a@b@c.de", "@" * 50, "token = \"0a1b2c3d4e5f60718293a4b5c6d7e8f901234567\" end", "",
]


def brute_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub("[^0-9]", "", m[0])
        if 14 <= len(g) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(g[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(s, e, k) for s, _, e, k in sorted(out)]


@pytest.mark.parametrize("t", PERSONAL)
def test_base_spans(t):
    assert pii.base_spans(t) == brute_spans(t)


def test_pii_rows(spark):
    rows = DOCS + list(enumerate(PERSONAL, 50))
    have = sorted((str(r.doc_id), [tuple(s)[:3] for s in r.base]) for r in pii.found(docs(spark, rows), "doc_id").collect())
    assert have == sorted((str(d), brute_spans(t or "")) for d, t in rows)
    assert pii.found(docs(spark, []), "doc_id").count() == 0
    assert pii.digest("a@b.c") == hashlib.sha256(b"email:0:5").hexdigest()


def test_votes_train_a_classifier(spark):
    keys = [prose(9, k) + f' token = "{hashlib.sha1(bytes([k])).hexdigest()}" ' + prose(5, k) for k in range(30)]
    paths = [prose(9, k) + f" /page-section-number-{k} " + prose(5, k) for k in range(60)]
    spans = pii.found(docs(spark, list(enumerate(keys + paths))), "doc_id")
    take = pii.accepted(spans)
    chosen = {r.doc_id for r in spans.collect() if any(s.pattern in take for s in r.more)}
    assert chosen == set(range(30))
    assert pii.accepted(pii.found(docs(spark, []), "doc_id")) == []


def test_labelers_that_err_are_trusted_less():
    r = np.random.default_rng(4)
    truth = r.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.6])
    v = np.where(r.random((4000, 3)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    patterns, inverse, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    q, p = pii.reliabilities(patterns, n.astype(float))
    assert ((q[inverse.ravel()] > 0.5) == truth).mean() > 0.93
    assert p[1, 0, 1] > p[1, 1, 1] > p[1, 2, 1]


def test_masking(spark):
    t = "mail a@b.org or +1 (555) 123-4567"
    out = [r.text for r in pii.redacted(docs(spark, [(1, t), (2, None), (3, "")]), []).orderBy("doc_id").collect()]
    assert out == ["mail [EMAIL] or [PHONE]", None, ""]
    assert pii.masked("x 1.2.3.4@a.bc y", frozenset()) == "x [EMAIL] y"


LANGUAGES = {"aa": "ba na ka la ma ta".split(), "bb": "stre kro blu fri gne pla".split(), "cc": "ös üm ärt ötz über ße".split()}


def speech(lang, n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(LANGUAGES[lang], r.integers(1, 4))) for _ in range(n))


def test_language(spark):
    rows = [(k, speech(x, 40, k), x) for k, x in enumerate(list(LANGUAGES) * 20)]
    model = langid.fit(spark.createDataFrame(rows + [(99, "zz", None), (98, None, "aa")], "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"] and model.code.shape == (3, 3)
    asked = [(k, speech(x, 30, 500 + k)) for k, x in enumerate(list(LANGUAGES) * 10)]
    have = {r.doc_id: r for r in langid.identified(docs(spark, asked), model, "doc_id", "label").collect()}
    assert all(have[k].lang_pred == x for k, x in enumerate(list(LANGUAGES) * 10))
    assert all(0 <= r.score <= 1 and not r.ambiguous for r in have.values())


def test_language_edges(spark):
    rows = [(1, speech("aa", 30, 1), "aa"), (2, speech("bb", 30, 2), "bb")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    have = langid.identified(docs(spark), model, "doc_id", "text").collect()
    assert len(have) == len(DOCS)
    for r in have:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    nothing = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.identified(docs(spark), nothing, "doc_id").collect()} == {"und"}
    one = langid.fit(spark.createDataFrame([("abc def", "aa")], "text string, lang string"))
    assert {r.lang_pred for r in langid.identified(docs(spark, [(1, "abc"), (2, "?")]), one, "doc_id").collect()} == {"aa", "und"}


def test_language_chunks_count_every_trigram(monkeypatch):
    texts = pa.array(["ab cd", "", "éa xyz " * 9, "q", None or "", LONG[:5000]])

    def counts(chunk):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        total = np.zeros((len(texts), langid.FEATURES + 1), int)
        for bounds, ids in langid.trigrams(texts):
            for k in range(len(texts)):
                total[k] += np.bincount(ids[bounds[k]:bounds[k + 1]], minlength=langid.FEATURES + 1)
        return total

    assert (counts(7) == counts(1 << 20)).all()


def test_codewords_correct_errors():
    for n in (2, 3, 4, 5, 12, 30):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n and set(np.unique(code)) == {-1, 1}
    assert langid.codewords(4).shape == (4, 7)


def test_quality_learns(spark):
    good = [(k, prose(80, k)) for k in range(120)]
    bad = [(500 + k, " | ".join(prose(80, 900 + k).split())) for k in range(60)]
    labels = spark.createDataFrame([(d, int(d < 500)) for d, _ in good + bad if d % 3] + [(7, None), (None, 1)], "doc_id long, quality int")
    table = docs(spark, good + bad)
    net = bytecnn.fit(table, labels)
    have = {r.doc_id: r.score for r in bytecnn.scored(table, net, "doc_id").collect()}
    held = [(d, s) for d, s in have.items() if d % 3 == 0]
    assert np.mean([(s >= 0.3) == (d < 500) for d, s in held]) > 0.95
    edges = bytecnn.scored(docs(spark), net, "doc_id", "text").collect()
    assert len(edges) == len(DOCS) and all(0 <= r.score <= 1 for r in edges)
    assert len({r.score for r in edges if not r.text}) == 1
    untrained = bytecnn.fit(table, labels.limit(0))
    assert {r.score for r in bytecnn.scored(docs(spark), untrained, "doc_id").collect()} == {0.5}


def test_network_sees_every_window(monkeypatch):
    """Pooling equals a plain loop, for any grouping of texts and pieces."""
    net = bytecnn.Network.fresh()
    texts = [b"", b"a", b"abcd", prose(90, 1).encode(), prose(400, 2).encode() + b"\0\xff"]
    pairs = net.paired()

    def plain(t):
        pooled = []
        for lo in range(0, max(1, len(t)), bytecnn.STRIDE):
            part = [p for p in range(lo, min(lo + bytecnn.STRIDE, len(t)))]
            wide = t + b"\0" * bytecnn.WIDTH
            best = [max((sum(net.filters[w][wide[p + w]][f] for w in range(bytecnn.WIDTH)) for p in part), default=-1) for f in range(bytecnn.FILTERS)]
            pooled.append(np.maximum(np.array(best) + net.bias, 0) if part else np.zeros(bytecnn.FILTERS))
        z = np.mean(pooled, 0) @ net.out + net.shift
        return 1 / (1 + np.exp(-z))

    want = [plain(t) for t in texts]
    np.testing.assert_allclose(net.scores(texts, pairs), want, rtol=1e-4)
    monkeypatch.setattr(bytecnn, "RUN_BYTES", 2 * bytecnn.STRIDE)
    np.testing.assert_allclose(net.scores(texts, pairs), want, rtol=1e-4)


ITEMS = [(1, prose(40, 61)), (2, prose(15, 62)), (3, "one two three"), (4, None), (5, ""), (6, prose(300, 63))]


def changed(text, every):
    w = text.split()
    return " ".join("zz" if k % every == every - 1 else x for k, x in enumerate(w))


def test_decontamination(spark):
    t1, t2, t6 = ITEMS[0][1], ITEMS[1][1], ITEMS[5][1]
    rows = [
        (1, prose(50, 1) + " " + t1 + " " + prose(50, 2)), (2, changed(t1, 7)), (3, "x " + changed(t2, 8) + " y"), (4, prose(200, 3)),
        (5, " ".join(t1.split()[:6])), (6, "ONE, two; three!"), (7, "one two"), (8, prose(30, 4) + " " + " ".join(t6.split()[100:120])),
        (9, t1 + "\n" + t2), (10, t1.upper().replace(" ", "!! ")), (11, None), (12, ""), (11, None), (None, t2),
        (13, " ".join(prose(3, 70 + k) + " " + " ".join(t6.split()[9 * k:9 * k + 5]) for k in range(20))),
    ]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {1: [1], 2: [1], 3: [2], 6: [3], 8: [6], 9: [1, 2], 10: [1], None: [2]}
    for most_words in (1_000_000, 60):  # one block, and several
        found = decontaminate.matched(docs(spark, rows).drop("items"), benchmark, "doc_id", most_words=most_words)
        have = [(r.doc_id, r["items"]) for r in found.collect()]
        assert len(have) == len(rows)
        assert {d: i for d, i in have if i} == want
    none = decontaminate.matched(docs(spark, rows), benchmark.limit(0), "doc_id").collect()
    assert all(r["items"] == [] for r in none) and len(none) == len(rows)
    assert decontaminate.matched(docs(spark, []), benchmark, "doc_id").count() == 0


def test_spaced_overlaps_equal_a_full_alignment():
    """Every pair whose alignment has enough equal words and a run of six is found."""
    block = decontaminate.Block(ITEMS)
    texts = [prose(10, k) + " " + changed(ITEMS[0][1], 5 + k % 4) + " " + prose(9, k) for k in range(12)] + [BASE, LONG]
    for t, found in zip(texts, block.overlaps(texts), strict=True):
        expected = "zz" in t and any(len(x.split()) >= 6 for x in t.split("zz"))
        assert (1 in found) == expected


def test_numbers_are_no_letters(spark):
    rows = [(k, w, "aa") for k, w in enumerate(["abc def ghi"] * 6)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, "½ ² ①"), (2, "一"), (3, "ª"), (4, "12 _"), (5, "ⅷ"), (6, "é")]
    have = {r.doc_id: r.lang_pred for r in langid.identified(docs(spark, asked), model, "doc_id").collect()}
    assert have == {1: "und", 2: "aa", 3: "aa", 4: "und", 5: "und", 6: "aa"}


def test_training_chunks_cover_the_text_as_scoring_does():
    rng = np.random.default_rng(3)
    net = bytecnn.Network.fresh()
    pairs = net.paired()
    step = bytecnn.STRIDE
    for n in (0, 1, step - 1, step, step + 1, 3 * step, 40 * step + 7):
        text = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        bag = bytecnn.chunks(text)
        assert b"".join([c[:step] for c in bag]) == text and len(bag) == max(1, -(-n // step))
        assert all(len(c) <= bytecnn.CHUNK for c in bag)
        seen = [net.pooled([c[:step]], pairs, c[step:])[0] for c in bag]
        assert np.allclose(np.mean(seen, 0), net.pooled_whole(text, pairs), atol=1e-5)


def test_quality_is_learned_from_the_end_of_long_texts(spark):
    """Texts of many chunks that differ in one chunk only, at a place that moves."""

    def long_text(k):
        head, tail = prose(400 + 31 * (k % 13), k), prose(900, k + 10_000)
        return f"{head} {'#$%&|<>' * 70 if k % 2 else prose(80, k + 20_000)} {tail}"

    table = spark.createDataFrame([(k, long_text(k)) for k in range(160)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(120)], "doc_id long, quality int")
    net = bytecnn.fit(table, labels)
    have = {r.doc_id: r.score >= 0.3 for r in bytecnn.scored(table, net, "doc_id").collect()}
    assert sum(have[k] == (k % 2 == 0) for k in range(120, 160)) >= 38
