"""Line deduplication over windows of consecutive lines.

Every ``window`` (three) consecutive lines of a text are hashed; windows overlap. Of each window that occurs more
than once in the corpus the first occurrence stays, by doc_id and position; lines covered by any later occurrence go.
Covered positions are merged, so overlapping windows remove each line once.

Only hashes move between machines until the end, when the documents meet their covered positions. A window with very
many occurrences is counted by partial aggregates, and its rows meet their first occurrence in a join that AQE splits.

Edge cases: null texts stay null, with no lines; the empty text is one empty line; a text with fewer lines than a
window is left alone; windows of nothing but blank lines don't count; null ids come before all others; rows that
repeat both id and text are one document, none later than the other, and are repeated in the result; an empty table
gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import map_batches, own_columns, with_field, written

WINDOW = 3


def _key(x: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(x, 256)), 1, 16)


def windows(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, pos, key): pos is the window's first line, from 0.

    Each line is hashed and judged blank once and a window hashes its lines' hashes, so a task copies a text about
    once, not again for each line of each window."""
    def line(x: Column) -> Column:
        # Stripped from the left only: that ends at the first other character and copies nothing before it.
        return F.struct(F.sha2(x, 256).alias("sha"), (F.ltrim(x, F.lit(" \t\r\x0b\x0c")) != "").alias("solid"))

    lines = F.split(text_col, "\n", -1)
    rows = docs.where(F.size(lines) >= window).select(
        F.col(id_col).cast("long").alias("doc_id"), _key(F.col(text_col)).alias("text_key"),
        F.transform(lines, line).alias("lines"))

    def at(i: Column) -> Column:
        part = F.slice(F.col("lines"), i + 1, window)
        return F.when(F.exists(part, lambda x: x.solid),
                      F.struct(i.alias("pos"), _key(F.concat_ws("", part.sha)).alias("key")))

    starts = F.sequence(F.lit(0), F.size("lines") - window)
    return (rows.select("doc_id", "text_key", F.explode(F.transform(starts, at)).alias("w")).where("w is not null")
            .select("doc_id", "text_key", "w.pos", "w.key"))


def later_occurrences(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, starts): first lines of windows that occurred before; starts is bounded by the text."""
    place = F.struct("doc_id", "text_key", "pos")
    first = (found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .where("first <> last").select(F.col("key").alias("key_"), "first"))
    first = written(first, "repeated-windows")
    later = found.join(first, F.col("key") == F.col("key_")).where(place > F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("starts"))


def keep_lines(text: str, starts: list[int], window: int) -> tuple[str, int]:
    """The text without covered lines, and how many went."""
    lines = text.split("\n")
    kept, at = [], 0
    for start in sorted(starts):
        if start > at:
            kept.extend(lines[at:start])
        at = max(at, start + window)
    kept.extend(lines[at:])
    return "\n".join(kept), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id",
                removed_col: str = "n_removed") -> DataFrame:
    """The documents with later occurrences removed from their text, plus how many lines went (long)."""
    found = written(windows(docs, window, text_col, id_col), "windows")
    starts, id_, key, removed = own_columns(docs, "starts", "id_key", "text_key", removed_col)
    later = later_occurrences(found).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key),
                                            F.col("starts").alias(starts))
    # Merged at any size: whether the covered positions would fit a broadcast grows with the corpus.
    joined = docs.join(written(later, "covered").hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col(id_))
                       & (_key(F.col(text_col)) == F.col(key)), "left").drop(id_, key)
    at, last = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = [], []
            for text, where in zip(b.column(at), b.column(last), strict=True):
                if where.is_valid:
                    new, n = keep_lines(text.as_py(), where.as_py(), window)
                else:
                    new, n = text.as_py(), 0
                texts.append(new)
                gone.append(n)
            columns = b.columns[:last]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())],
                                             names=[*b.schema.names[:last], removed])

    return map_batches(joined, run, with_field(docs.schema, removed, LongType()))


def line_count(text_col: str) -> Column:
    """Lines of a text; null has none."""
    return F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n", -1))).cast("long")
