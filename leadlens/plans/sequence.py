"""Skew-proof ordered sequences per key (row numbers, running sums, previous values).

``Window.partitionBy(key)`` puts every row of a key into one task; a key
holding a third of all rows would be one straggler. Here rows are instead
range-partitioned on (key, order...), so a hot key is spread over many
partitions, and each partition is processed with windows over
(partition id, key) — bounded by the partition size. The part of a result
that depends on earlier partitions ("carry") only exists for the first key of
a partition (range order: a key can only continue from the partitions right
before), so the carry table has at most one row per partition and is
broadcast with a proven size bound.

The laid-out data is checkpointed (to ``spark.checkpoint.dir``) so partition
ids stay stable between the passes that read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.session import checkpoint_root

PID = "_pid"


def lay_out(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """Range-partition on (key, order), sort inside partitions, tag the partition id, checkpoint."""
    spark = df.sparkSession
    checkpoint_root(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
            .withColumn(PID, F.spark_partition_id()))
    return laid.checkpoint(eager=True)


def _local(key: str, order: list[str]) -> Window:
    return Window.partitionBy(PID, key).orderBy(*order)


def _carries(laid: DataFrame, key: str, order: list[str], sums: dict[str, Column],
             prev_cols: list[str]) -> DataFrame:
    """Per (partition, key) that continues a key from earlier partitions:
    rows and sums of the earlier partitions, and the previous row's values
    (the last row of the nearest earlier partition holding the key)."""
    per = laid.groupBy(PID, key).agg(F.count(F.lit(1)).alias("_n"),
                                     *[F.sum(c).alias("_s_" + n) for n, c in sums.items()])
    by_key = Window.partitionBy(key).orderBy(PID)
    w = by_key.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(PID, key, F.sum("_n").over(w).alias("_carry_n"), F.lag(PID).over(by_key).alias("_prev_pid"),
                     *[F.sum("_s_" + n).over(w).alias("_carry_" + n) for n in sums])
    carries = per.filter(F.col("_carry_n") > 0)      # at most one row per partition
    if prev_cols:
        last = F.struct(key, *order)
        lasts = laid.groupBy(PID).agg(*[F.max_by(c, last).alias("_last_" + c) for c in prev_cols]) \
            .withColumnRenamed(PID, "_prev_pid")
        carries = carries.join(F.broadcast(lasts), "_prev_pid", "left")
    return carries.drop("_prev_pid")


def sequence(laid: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None,
             prev_cols: list[str] | None = None) -> DataFrame:
    """Adds ``_rn`` (1-based position of the row within its key), ``_before_<name>``
    (sum of ``sums[name]`` over earlier rows of the key) and ``_prev_<col>``
    (value of ``col`` on the previous row of the key, NULL on the first)."""
    sums, prev_cols = sums or {}, prev_cols or []
    w = _local(key, order)
    cols = [F.row_number().over(w).alias("_lrn")]
    cols += [F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lb_" + n)
             for n, c in sums.items()]
    cols += [F.lag(c).over(w).alias("_lp_" + c) for c in prev_cols]
    local = laid.select("*", *cols)
    carries = _carries(laid, key, order, sums, prev_cols)
    # NULL is a key like any other: its rows continue from earlier partitions too.
    carries = carries.withColumnRenamed(PID, "_c_pid").withColumnRenamed(key, "_c_key")
    same = (F.col(PID) == F.col("_c_pid")) & F.col(key).eqNullSafe(F.col("_c_key"))
    j = local.join(F.broadcast(carries), same, "left")
    out = [F.col("_lrn") + F.coalesce("_carry_n", F.lit(0))]
    names = ["_rn"]
    for n in sums:
        out.append(F.col("_lb_" + n) + F.coalesce("_carry_" + n, F.lit(0)))
        names.append("_before_" + n)
    for c in prev_cols:
        out.append(F.when(F.col("_lrn") == 1, F.col("_last_" + c)).otherwise(F.col("_lp_" + c)))
        names.append("_prev_" + c)
    keep = [c for c in laid.columns]
    return j.select(*keep, *[e.alias(n) for e, n in zip(out, names)])


def positions(df: DataFrame, order: list[Column], name: str = "pos", key: str | None = None) -> DataFrame:
    """``df`` with the 1-based position of each row among all rows, or those of its ``key``, by ``order`` (ascending).

    The rows are range-partitioned on the order and counted per partition, so no task sorts them all."""
    marks = [f"_order{i}" for i in range(len(order))]
    one = "_whole" if key is None else key
    marked = df.withColumns({m: c for m, c in zip(marks, order)} | ({one: F.lit(0)} if key is None else {}))
    return sequence(lay_out(marked, one, marks), one, marks).select(*df.columns, F.col("_rn").cast("long").alias(name))
