"""How the index is built: each text is cut once and dealt as one row."""

from pyspark.sql import functions as F

from helpers import rows
from test_search import setup, thread
from threadlens.functions import text
from threadlens.operators import index, substrings


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_not_shuffled(spark):
    t, p, _, _ = setup(spark, [thread("a", ["x"], "one two one"), thread("b")], [("u", "a", "two@x")])
    for built in (index.terms(t, p, 3), substrings.grams(substrings.fields(t, p), 3)):
        # One exchange, below the step that makes a row of each token; sizes of lists are not tested first.
        assert plan(built).count("Exchange") == 1
        assert plan(built).index("Generate") < plan(built).index("Exchange")
        assert "size(" not in plan(built)
    assert "size(" not in plan(index.positions(t, p, 3)).split("Generate")[1].replace("size(tokens", "")


def test_texts_are_dealt_before_they_are_cut(spark):
    t, p, _, _ = setup(spark, [thread("a", ["x"], "one two one"), thread("b")], [("u", "a", "two@x")])
    # Lists of tokens take twice the bytes of the text in a shuffle.
    assert "split(" not in plan(index.terms(t, p, 3)).split("Exchange")[1]
    positions = plan(index.positions(t, p, 3))
    assert positions.index("split(") < positions.index("Exchange")


def test_ascii_texts_are_cut_as_others_are(spark):
    texts = ["", None, " ", "One_two-THREE 4", "x\u0301y \u00c9COLE", "\u0130stanbul \u212a 1\u00bd", "a\x00b\tc", "\u00e9"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    plain = F.array_remove(F.split(text.fold(F.col("x")), text.TOKEN_BREAK), "")
    got = df.select("k", text.tokens(F.col("x")).alias("got"), plain.alias("plain")).orderBy("k").collect()
    assert [r.got for r in got] == [r.plain for r in got]
    assert got[3].got == ["one", "two", "three", "4"] and got[1].got is None


def test_equal_rows_and_nulls_fold(spark):
    twice = [thread("a", ["x"], "one two one"), thread("a", ["x"], "one two one"), thread(None, [], "n", user=None),
             thread(None, [], "n m", user=None)]
    people = [("u", "a", "two@x"), ("u", "a", "two@x"), ("u", "a", None), (None, None, "m@n")]
    t, p, _, _ = setup(spark, twice, people)
    for parts in (None, 5):
        got = rows(index.terms(t, p, parts), "user_id", "thread_id", "token")
        assert got == sorted([("u", "a", "one"), ("u", "a", "two"), ("u", "a", "x"), (None, None, "n"), (None, None, "m")], key=str)
        grams = substrings.grams(substrings.fields(t, p), parts)
        assert grams.count() == grams.distinct().count()
        assert grams.filter("thread_id IS NULL AND gram = 'n'").count() == 1


def test_files_are_ordered_by_token(spark, tmp_path):
    t, p, _, _ = setup(spark, [thread(f"t{i}", ["b"], f"c{i} a") for i in range(30)])
    index.write(index.terms(t, p, 4), f"{tmp_path}/terms")
    files = [f for f in (tmp_path / "terms").iterdir() if f.suffix == ".parquet"]
    assert len(files) > 1
    for f in files:
        read = [r.token for r in spark.read.parquet(str(f)).collect()]
        assert read == sorted(read)
