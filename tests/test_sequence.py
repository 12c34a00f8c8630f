import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadlens.plans.sequence import lay_out, sequence
from tests.conftest import rows


def test_sequence_matches_windows_with_hot_key(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}", i, rnd.randint(0, 5), rnd.choice("ab"))
            for i in range(600)]
    df = spark.createDataFrame(data, "key string, id long, v long, r string")
    laid = lay_out(df, "key", ["id"], partitions=7)
    hot_parts = laid.filter(F.col("key") == "hot").select("_pid").distinct().count()
    assert hot_parts > 2  # the hot key really is spread over several partitions
    got = sequence(laid, "key", ["id"], sums={"v": F.col("v")}, prev_cols=["r"])
    w = Window.partitionBy("key").orderBy("id")
    exp = df.select("id", F.row_number().over(w).alias("_rn"),
                    F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before_v"),
                    F.lag("r").over(w).alias("_prev_r"))
    a = sorted(rows(got, "id", "_rn", "_before_v", "_prev_r"))
    b = sorted(rows(exp, "id", "_rn", "_before_v", "_prev_r"))
    assert a == b


def test_null_key_is_one_key(spark):
    from leadlens.plans.sequence import lay_out, sequence
    df = spark.range(40).selectExpr("cast(null as string) as k", "id")
    got = sequence(lay_out(df, "k", ["id"], partitions=5), "k", ["id"], prev_cols=["id"])
    assert sorted((r.id, r._rn, r._prev_id) for r in got.collect()) == [(i, i + 1, i - 1 if i else None) for i in range(40)]
