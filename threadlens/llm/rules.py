"""Quality rules: a table of thresholds compiled into one projection.

Lengths, symbol, stop-word, line and repetition ratios are built-in expressions
over the whole text; no user function runs. :func:`measured` adds the measures,
:func:`judged` compares each with its row of the table.

Defined results: a null or empty text has zero words and fails; repeated rows are
judged one by one; an empty table gives an empty table. Columns of the input that
are not asked for stay out, so names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, only, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
WORD_CHAR = r"[^\x20\x09-\x0D]"
#: What separates words when they are looked up in the list of stop words.
BETWEEN = r"""[\x20\x09-\x0D.,;:!?"'()]+"""

#: Frequent words of the languages that are kept.
STOP_WORDS = """
    the and of to in is that it for on with as was at by an be this from are
    der die das und ist nicht ein eine mit von den zu auf im für
    le la les de des et un une du en que qui pour dans sur par est
    el los las del y una por con para se su al es
""".split()


@dataclass(frozen=True)
class Threshold:
    """A measure that must lie between ``least`` and ``most``; None is open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: One row a rule.
THRESHOLDS = (
    Threshold("n_words", least=20),
    Threshold("mean_word_chars", least=2, most=16),
    Threshold("symbol_ratio", most=0.3),
    Threshold("shout_ratio", most=0.3),
    Threshold("stop_word_ratio", least=0.02),
    Threshold("dup_line_ratio", most=0.5),
    Threshold("repeat_word_ratio", most=0.3),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows of eight that occur twice or more in the array of word hashes."""
    def windows(hs: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(hs) - WINDOW), window)

    def covered(keyed: Column) -> Column:
        # Sorted by (hash, position): a window repeats when a neighbour has its hash.
        same = lambda x, i: F.coalesce(
            F.get(keyed, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(keyed, i + 1)["h"] == x["h"], F.lit(False))
        hits = F.sort_array(F.transform(F.filter(keyed, same), lambda x: x["i"]))
        # Each window adds the words up to the next repeated window, eight at most.
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(hits, start, step, lambda acc: acc["n"])

    def counted(ws: Column) -> Column:
        keyed = F.sort_array(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(ws)) < F.size(ws)
        return F.when(some, _let(keyed, covered)).otherwise(F.lit(0))

    return F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(
        _let(hashes, lambda hs: _let(windows(hs), counted))).cast("long")


def measured(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` and one column per measure for every row of ``docs``."""
    t = F.coalesce(F.col(text), F.lit(""))
    number = lambda chars: F.regexp_count(t, F.lit(f"[{chars}]")).cast("long")
    lists = docs.select(
        *[F.col(k) for k in keep],
        F.array_remove(F.split(t, SPACES), "").alias("_words"),
        F.split(F.lower(t), BETWEEN).alias("_bare"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD_CHAR)).alias("_lines"),
        (F.length(t) - number(r"\x20\x09-\x0D")).alias("word_chars"),
        number(SYMBOLS).alias("n_symbols"), number("!").alias("n_shouts"),
    )
    counts = lists.select(
        *keep, "word_chars", "n_symbols", "n_shouts",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.transform("_words", lambda w: F.xxhash64(w))).alias("n_repeat_words"),
        F.size(F.filter("_bare", lambda w: w.isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.select(
        "*",
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbol_ratio"),
        share("n_shouts", "n_words").alias("shout_ratio"),
        share("n_stop_words", "n_words").alias("stop_word_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        share("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )


def failed_rules(thresholds=THRESHOLDS) -> Column:
    """The table as one array expression: the measures that lie outside their bounds."""
    def outside(t: Threshold) -> Column:
        tests = [F.col(t.measure) < t.least] if t.least is not None else []
        tests += [F.col(t.measure) > t.most] if t.most is not None else []
        return F.when(reduce(lambda a, b: a | b, tests), F.lit(t.measure))

    return F.array_compact(F.array(*[outside(t) for t in thresholds]))


def judged(docs: DataFrame, *keep: str, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """:func:`measured` with ``failed`` (names of the failed rules) and ``kept``."""
    rated = measured(docs, *keep, text=text).withColumn("failed", failed_rules(thresholds))
    return rated.withColumn("kept", F.size("failed") == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts, the base rule and the verdict of the table."""
    rated = judged(only(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col("kept")).alias("kept"),
        F.concat_ws(",", "failed").alias("failed_rules"),
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

SQL = {
    "op6_quality_rules": f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (
    SELECT r, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM t)
), ww AS (
  SELECT r, i, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS win FROM w
  WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), hits AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM ww WHERE n = 8) WHERE c > 1
), rep AS (
  SELECT r, sum(least(8, i - before)) AS n_repeat_words
  FROM (SELECT r, i, lag(i, 1, -100) OVER (PARTITION BY r ORDER BY i) AS before FROM hits) GROUP BY r
), per AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars
  FROM w GROUP BY r
), l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_shouts,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D.,;:!?"''()]+'), lambda x: x IN ({_STOP_SQL}))) AS n_stop
  FROM t LEFT JOIN per USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',',
    CASE WHEN n_words < 20 THEN 'n_words' END,
    CASE WHEN n_words = 0 OR word_chars / n_words < 2 OR word_chars / n_words > 16 THEN 'mean_word_chars' END,
    CASE WHEN n_words > 0 AND n_symbols / n_words > 0.3 THEN 'symbol_ratio' END,
    CASE WHEN n_words > 0 AND n_shouts / n_words > 0.3 THEN 'shout_ratio' END,
    CASE WHEN n_words = 0 OR n_stop / n_words < 0.02 THEN 'stop_word_ratio' END,
    CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'dup_line_ratio' END,
    CASE WHEN n_words > 0 AND n_repeat_words / n_words > 0.3 THEN 'repeat_word_ratio' END) AS failed_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM f""",
}

QUERIES = {"op6_quality_rules": op6_quality_rules}
