"""How collected batches are stored."""

from threadlens.operators import batches


def test_a_batch_is_one_file_and_is_replaced(spark, tmp_path):
    def left(n):
        return spark.range(n).repartition(8).selectExpr(
            "'u' AS user_id", "concat('t', id) AS thread_id", "if(id % 10 = 9, null, concat('b', id % 10)) AS batch_id")

    batches._write(left(400), str(tmp_path), "left")
    assert len(list((tmp_path / "left").rglob("*.parquet"))) == 10
    batches._write(left(400).filter("batch_id = 'b1'").limit(3), str(tmp_path), "left")
    counts = {r.batch_id: r["count"] for r in batches.read(spark, str(tmp_path), "left").groupBy("batch_id").count().collect()}
    assert counts == {None: 40, **{f"b{k}": 3 if k == 1 else 40 for k in range(9)}}
