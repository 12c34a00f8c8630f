"""Bounded training samples and text windows shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Labels learned at most, those with the most documents; evenly spaced windows that a long text is sampled by.
MOST_LABELS, WINDOWS = 64, 8


def crc_bucket(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def bounded_text(text: Column, max_chars: int) -> Column:
    """The whole text up to ``max_chars`` characters, of a longer one WINDOWS evenly spaced pieces of that many in all."""
    size = max_chars // WINDOWS
    step = (F.length(text) - size) / F.lit(WINDOWS - 1)
    pieces = [F.substring(text, (F.floor(step * k) + 1).cast("int"), F.lit(size)) for k in range(WINDOWS)]
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat_ws(" ", *pieces))


def _first_ids(ids: DataFrame, per_label: int) -> DataFrame:
    """The ``per_label`` rows of each label with the least turn, for a bounded number of labels.

    Turns are hashes in hex. Counts of their first digits tell where each label's share ends, so only the rows up to
    there are ranked: no task gets a label's rows, however many it has."""
    head = F.substring("turn", 1, 4)
    counts = ids.groupBy("label", head.alias("head")).agg(F.count(F.lit(1)).alias("n"))  # 65,536 rows a label at most
    before = F.sum("n").over(Window.partitionBy("label").orderBy("head").rowsBetween(Window.unboundedPreceding, -1))
    ends = (counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < per_label)
            .groupBy("label").agg(F.max("head").alias("end")))
    first = F.row_number().over(Window.partitionBy("label").orderBy("turn", "id"))
    return (ids.join(F.broadcast(ends), "label").where(head <= F.col("end")).withColumn("at", first)
            .where(F.col("at") <= per_label))


def training_rows(docs: DataFrame, label: str, per_label: int, max_chars: int, text_col: str = "text",
                  id_col: str = "doc_id", most_labels: int = MOST_LABELS, known: DataFrame | None = None) -> list:
    """At most ``per_label`` distinct ids of each of at most ``most_labels`` labels, in an order given by a hash of the
    id: [(label, text)]. Labels are a column of ``docs``, or of ``known``, one row per id, which is joined on the id.

    Of rows that share label and id the one with the least text hash is taken. Texts longer than ``max_chars`` enter by
    evenly spaced windows of that many characters in all, so the driver holds at most most_labels x per_label x
    (max_chars + WINDOWS) characters whatever the table holds. Ids may be of any type. Texts are read twice, once for
    their hashes and once for those chosen, and never shuffled.
    """
    texts = docs.where(F.length(text_col) > 0).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"),
        *([] if known is not None else [F.col(label).alias("label")]))
    narrow = texts.drop("text")
    if known is not None:
        narrow = narrow.join(known.select(F.col(id_col).alias("id"), F.col(label).alias("label")), "id")
    ids = written(narrow.groupBy("label", "id").agg(F.min("text_hash").alias("text_hash"))
                  .withColumn("turn", F.md5(F.col("id").cast("string"))), "labelled-ids")
    common = ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(most_labels)
    chosen = written(_first_ids(ids.join(F.broadcast(common.select("label")), "label"), per_label)
                     .select("label", "id", "text_hash"), "chosen-ids")
    # most_labels x per_label narrow rows at most.
    on = ["id", "text_hash"] + ([] if known is not None else ["label"])
    rows = (texts.join(F.broadcast(chosen), on).dropDuplicates(["label", "id"])
            .select("label", "id", bounded_text(F.col("text"), max_chars).alias("text")).collect())
    return [(r.label, r.text) for r in sorted(rows, key=lambda r: (str(r.id), r.text))]
