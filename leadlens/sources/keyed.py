"""Tables that streams upsert by key: Parquet buckets, each as the parts of the micro-batches that changed it.

``<root>/data/v=b/bucket=k`` holds the rows that batch b changes, ``<root>/whole/v=b/bucket=k`` the buckets that it
rewrote because they had MOST_PARTS parts, and ``<root>/manifest/batch_id=b`` the parts of every bucket after it, written
last. A batch writes its own rows, and reads only the buckets that it rewrites, whatever the number of batches before it;
a reader puts at most MOST_PARTS parts of a bucket together. A replayed batch starts from the manifest before its own and
overwrites its own folders, so it changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
#: Parts of a bucket that readers merge, at most; then the bucket is rewritten.
MOST_PARTS = 8
Merge = Callable[[DataFrame], DataFrame]


def _manifest(spark: SparkSession, root: str, before: int | None = None) -> dict[int, list[str]]:
    """{bucket: its parts, oldest first} after the last batch (before batch ``before``): at most MOST_PARTS a bucket."""
    at = f"{root}/manifest"

    def parts(log: DataFrame) -> dict[int, list[str]]:
        return {r.bucket: list(r.parts) for r in log.collect()}

    if before is not None:  # the batch right before, as a rule, without listing the others
        try:
            return parts(spark.read.parquet(f"{at}/batch_id={before - 1}"))
        except AnalysisException:
            pass
    try:
        log = spark.read.parquet(at)
    except AnalysisException:  # no batch has been written
        return {}
    log = log if before is None else log.where(F.col("batch_id") < before)
    newest = log.agg(F.max("batch_id")).first()[0]
    return parts(log.where(F.col("batch_id") == F.lit(newest)))


def _read(spark: SparkSession, root: str, parts: dict[int, list[str]], schema, key: str | None, merge: Merge | None) -> DataFrame:
    """The given buckets from their parts: the newest row of a key, or what ``merge`` makes of all its rows."""
    single = [f"{root}/{p[0]}/bucket={b}" for b, p in sorted(parts.items()) if len(p) == 1]
    rows = spark.read.schema(schema).parquet(*single) if single else spark.createDataFrame([], schema)
    several = {b: p for b, p in parts.items() if len(p) > 1}
    if not several:
        return rows
    by_age = []
    for age in range(max(map(len, several.values()))):
        paths = [f"{root}/{p[age]}/bucket={b}" for b, p in sorted(several.items()) if len(p) > age]
        by_age.append(spark.read.schema(schema).parquet(*paths).withColumn("_age", F.lit(age)))
    both = by_age[0]
    for more in by_age[1:]:
        both = both.unionByName(more)
    if merge:
        return rows.unionByName(merge(both.drop("_age")))
    key = key or rows.columns[0]
    newest = both.groupBy(key).agg(*(F.max_by(c, "_age").alias(c) for c in rows.columns if c != key))
    return rows.unionByName(newest.select(*rows.columns))


def _write(rows: DataFrame, key: str, buckets: int, at: str) -> None:
    """Rows by bucket, each spread over a few files."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(4))).write.mode("overwrite").partitionBy("bucket") \
        .option("compression", "zstd").parquet(at)


def upsert(changed: DataFrame, key: str, root: str, batch_id: int, buckets: int = BUCKETS, merge: Merge | None = None) -> None:
    """Replace the rows of ``changed``'s keys, at most one row each, by those of ``changed``; with ``merge``, which takes
    old and new rows of any keys and gives one row a key with the same columns, by what it makes of both."""
    spark = changed.sparkSession
    own = f"data/v={batch_id}"
    _write(changed, key, buckets, f"{root}/{own}")  # once: the stream's state is not computed twice
    new = spark.read.schema(T.StructType([*changed.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{root}/{own}")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # no more than buckets
    parts = _manifest(spark, root, batch_id)
    parts |= {b: [*parts.get(b, []), own] for b in touched}
    full = {b: p for b, p in parts.items() if len(p) > MOST_PARTS}
    if full:
        whole = f"whole/v={batch_id}"
        _write(_read(spark, root, full, changed.schema, key, merge), key, buckets, f"{root}/{whole}")
        parts |= {b: [whole] for b in full}
    spark.createDataFrame(sorted(parts.items()), "bucket int, parts array<string>").coalesce(1).write.mode("overwrite") \
        .parquet(f"{root}/manifest/batch_id={batch_id}")


def table(spark: SparkSession, root: str, schema, key: str | None = None, merge: Merge | None = None) -> DataFrame:
    """The table as of the last batch. ``key`` (else the first column) and ``merge`` as in its upserts."""
    return _read(spark, root, _manifest(spark, root), schema, key, merge)
