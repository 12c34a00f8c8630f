"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z; null counts as the empty text. A Misra-Gries summary of
``counters`` digests per task, merged into one of the same size, holds every digest with more than
rows / (counters + 1) copies. An exact pass verifies those candidates and picks their winners; that table has at
most ``counters`` rows, so it is broadcast and hot groups never shuffle. The remaining digests, each with a bounded
share of the rows, are counted and joined by ordinary shuffles.

Edge cases: null and empty texts form one group; of equal texts the largest doc_id stays, null ids being smallest;
of rows that also share that id exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed

COUNTERS = 1000


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(rid, doc_id, digest): one narrow row per document, computed from the text once. rid tells rows apart."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return checkpointed(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest")))


def misra_gries(rows: DataFrame, counters: int = COUNTERS) -> list[bytes]:
    """Candidates for frequent digests: at most ``counters``, none with more than rows / (counters + 1) missing."""

    def cut(held: dict[bytes, int]) -> dict[bytes, int]:
        if len(held) <= counters:
            return held
        least = heapq.nlargest(counters + 1, held.values())[-1]
        return {d: n - least for d, n in held.items() if n > least}

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            seen = pc.value_counts(batch.column(0))
            for d, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True):
                held[d] = held.get(d, 0) + n
            held = cut(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["digest", "n"])

    merged = (rows.select("digest").mapInArrow(summarise, "digest binary, n long")
              .groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(counters + 1))
    return list(cut({bytes(r.digest): r.n for r in merged.collect()}))  # counters + 1 rows at most


def groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_rid, group_size), with map-side partial aggregation."""
    best = F.max(F.struct("doc_id", "rid")).alias("best")
    return (rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"),
                    "group_size"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (SHA-256 of the lower-cased text)."""
    rows = digests(docs, text_col, id_col)
    spark = rows.sparkSession
    named = spark.createDataFrame([(bytearray(d),) for d in misra_gries(rows, counters)], "digest binary")
    heavy = checkpointed(groups(rows.join(F.broadcast(named), "digest")).where("group_size > 1"))
    light_rows = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    split = (rows.join(F.broadcast(heavy), "digest")
             .unionByName(light_rows.join(groups(light_rows), "digest")))
    return split.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "digest")
