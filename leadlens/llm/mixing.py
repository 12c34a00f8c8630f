"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source. A token budget enters at the root; each node splits its own among its
children by weight, no child getting more than its subtree can give (its tokens times ``max_epochs``). What a child
cannot take goes to its siblings by weight, and only when a whole subtree is exhausted does its shortage reach the
siblings of its parent. One level is one pass of "water-filling": children sorted by capacity per weight, the
exhausted ones a prefix of that order. All amounts are whole tokens.

A leaf with budget b and s tokens gives b div s full epochs and, of the next epoch, the prefix with at most b mod s
tokens in that epoch's seeded order. A leaf may hold a third of the corpus, so it is never sorted whole: tokens are
summed per bucket of the order's hash, buckets before the border are taken whole, and only the border bucket's rows
are sorted.

Edge cases: null domain, language or source are the name ''; documents without words cost nothing, and a leaf of
such documents only is left out; weights of zero or null take no budget; rows repeated with id and text are separate
rows; an empty table gives an empty result; other columns pass through, and working columns never clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_columns, written

#: Plans of up to so many leaves are broadcast; larger ones join by shuffles, where AQE splits hot leaves.
BROADCAST_LEAVES = 50_000
#: Buckets of a leaf's order: the first hex digits of a hash.
BUCKET_DIGITS = 3
LEVELS = ("domain", "language", "origin")

WORD = "[^\\x20\\x09-\\x0D]+"


def word_tokens(text: Column) -> Column:
    """Words as tokens: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(id_: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")),
                             F.md5(F.coalesce(text, F.lit("")))))


def epoch_key(key: Column, epoch: Column) -> Column:
    """Each epoch has an order of its own."""
    return F.md5(F.concat_ws(":", epoch.cast("string"), key))


def fill(children: DataFrame, on: list[str], name: str) -> DataFrame:
    """Split ``total``, the budget of each parent (``on``), among its children by ``weight`` up to ``capacity``."""
    big = "decimal(38,0)"
    order = Window.partitionBy(*on).orderBy(F.col("capacity") / F.col("weight"), name)
    whole = Window.partitionBy(*on)
    left = (F.col("total") - F.col("before")).cast("decimal(20,0)")
    rows = (children.where("weight > 0 and capacity > 0")
            .withColumn("before", F.coalesce(F.sum("capacity").over(
                order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("full", F.col("capacity").cast("decimal(20,0)") * F.col("weights").cast("decimal(18,0)")
                        <= F.col("weight").cast("decimal(18,0)") * left)
            .withColumn("taken", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole))
            .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(whole)))
    share = F.expr(f"cast(weight * cast(total - taken as decimal(20,0)) as {big}) div cast(open as {big})")
    return rows.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share)).drop(
        "before", "weights", "full", "taken", "open", "total")


def leaf_budgets(leaves: DataFrame, budget: int | None, max_epochs: int,
                 weights: tuple[Column, Column, Column]) -> DataFrame:
    """leaves: domain, language, origin, supply. Adds weight, capacity and budget; weights see those three columns.

    budget None: as many tokens as the corpus has.
    """
    leaves = leaves.where("supply > 0").withColumn("capacity", F.col("supply") * max_epochs)
    if budget is None:
        budget = leaves.agg(F.sum("supply")).first()[0] or 0
    parents, on = None, []
    for depth, weight in enumerate(weights):
        at = list(LEVELS[:depth + 1])
        level = leaves.withColumn("weight", weight.cast("long")).groupBy(*at).agg(
            F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply"), F.max("weight").alias("weight"))
        level = (level.withColumn("total", F.lit(budget).cast("long")) if parents is None
                 else level.join(parents.select(*on, F.col("budget").alias("total")), on))
        parents, on = fill(level, on, LEVELS[depth]), at
    return parents


def mix(docs: DataFrame, weights: tuple[Column, Column, Column], domain: Column, language: Column, origin: Column,
        budget: int | None = None, max_epochs: int = 3, seed: int = 42, text_col: str = "text",
        id_col: str = "doc_id", tokens: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, plan).

    chosen: the documents, once for each epoch in which they are used, with ``epoch`` (int, from 0), ``domain`` and
    ``n_tokens``; a name that the table has already gets an underscore. plan: one row per leaf with supply,
    capacity, weight and budget.
    """
    epoch, dom, n_tokens, lang, orig, key, bucket, full, border, room, kept, run = own_columns(
        docs, "epoch", "domain", "n_tokens", "language", "origin", "order_key", "bucket", "full_epochs", "border",
        "room", "rest_taken", "running")
    tokens = word_tokens(F.col(text_col)) if tokens is None else tokens
    tagged = docs.withColumns({
        dom: F.coalesce(domain.cast("string"), F.lit("")), lang: F.coalesce(language.cast("string"), F.lit("")),
        orig: F.coalesce(origin.cast("string"), F.lit("")), n_tokens: tokens,
        key: order_key(F.col(id_col), F.col(text_col), seed)})
    narrow = written(tagged.select(*(F.col(x).alias(y) for x, y in zip((dom, lang, orig), LEVELS, strict=True)),
                                   F.col(n_tokens).alias("n"), F.col(key).alias("key")), "mix-rows")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n").alias("supply"))
    plan = written(leaf_budgets(leaves, budget, max_epochs, weights), "mix-plan")
    cut = plan.withColumns({"full_epochs": F.expr("cast(budget div supply as int)"),
                            "rest": F.expr("budget % supply")}).select(*LEVELS, "full_epochs", "rest")
    small = plan.count() <= BROADCAST_LEAVES
    sized = F.broadcast(cut) if small else cut
    sums = (narrow.join(sized, list(LEVELS)).withColumn(
                "bucket", F.substring(epoch_key(F.col("key"), F.col("full_epochs")), 1, BUCKET_DIGITS))
            .groupBy(*LEVELS, "full_epochs", "rest", "bucket").agg(F.sum("n").alias("n")))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    borders = (sums.withColumn("upto", upto).where("upto > rest").groupBy(*LEVELS)
               .agg(F.min(F.struct("bucket", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("room"))).alias("b")))
    cut = written(cut.join(borders, list(LEVELS), "left").select(
        F.col("domain").alias(dom), F.col("language").alias(lang), F.col("origin").alias(orig),
        F.col("full_epochs").alias(full), F.col("b.bucket").alias(border), F.col("b.room").alias(room)), "mix-cut")
    tagged = tagged.join(F.broadcast(cut) if small else cut, [dom, lang, orig]).withColumn(
        bucket, F.substring(epoch_key(F.col(key), F.col(full)), 1, BUCKET_DIGITS))
    clear = tagged.where(F.col(bucket) != F.col(border)).withColumn(kept, F.col(bucket) < F.col(border))
    inside = Window.partitionBy(dom, lang, orig).orderBy(epoch_key(F.col(key), F.col(full))).rowsBetween(
        Window.unboundedPreceding, 0)
    sorted_ = (tagged.where(F.col(bucket) == F.col(border)).withColumn(run, F.sum(n_tokens).over(inside))
               .withColumn(kept, F.col(run) <= F.col(room)).drop(run))
    times = F.col(full) + F.col(kept).cast("int")
    chosen = clear.unionByName(sorted_).where(times > 0).withColumn(
        epoch, F.explode(F.sequence(F.lit(0), times - 1)))
    return chosen.select(*docs.columns, epoch, dom, n_tokens), plan
