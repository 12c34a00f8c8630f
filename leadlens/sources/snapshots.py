"""Versioned table snapshots in the shared checkpoint folder.

Mutations produce new tables; writing them (instead of chaining more
transforms on top) cuts the lineage, so a lost executor re-reads a written
file rather than recomputing the cascade, and readers switch versions by
path. Each write goes to a fresh version folder that is never overwritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.session import checkpoint_root


def write_snapshot(df: DataFrame, name: str, version: str | None = None) -> DataFrame:
    """Write ``df`` as ``<checkpoint dir>/snapshots/<name>/v=<version>`` and read it back."""
    spark = df.sparkSession
    v = version or uuid.uuid4().hex
    path = f"{checkpoint_root(spark)}/snapshots/{name}/v={v}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def write_tables(tables: dict[str, DataFrame], prefix: str) -> dict[str, DataFrame]:
    """Write a set of tables under one version id and publish it: the manifest is written last, so readers of
    ``published`` see all tables of a version or none (a failure in between leaves the earlier version)."""
    v = uuid.uuid4().hex
    out = {n: write_snapshot(df, f"{prefix}/{n}", v) for n, df in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    names = F.array(*[F.lit(n) for n in tables])
    spark.range(1).select(F.lit(v).alias("version"), names.alias("tables"),
                          F.current_timestamp().alias("published_at")).write.mode("append").parquet(
        f"{checkpoint_root(spark)}/snapshots/{prefix}/manifest")
    return out


def published(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    """The tables of the newest published version."""
    root = f"{checkpoint_root(spark)}/snapshots/{prefix}"
    log = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/manifest")
    newest = log.orderBy(F.desc("published_at")).first()
    return {n: spark.read.parquet(f"{root}/{n}/v={newest.version}") for n in newest.tables}
