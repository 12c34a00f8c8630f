"""Token counts: an exact length histogram whose suffix sums answer every context limit.

Texts are encoded whole with a public byte-level BPE (ranks in a file that is a parameter, sent to the workers once)
and only their lengths are kept: documents are aggregated by encoded length. For a limit L, documents and tokens beyond
L are suffix sums, and the tokens that remain after cutting each text at L are the tokens of texts within L plus L for
each longer one. Between two lengths of the histogram nothing changes but that last product, so the table at the
histogram's lengths answers every limit.

Suffix sums run in two levels, within blocks of lengths and over blocks, so that no task sorts the whole histogram.

Edge cases: null and empty texts have zero tokens and are counted; special-token strings are ordinary text; repeated
rows count each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import map_batches, with_field, written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before the merges of the rank file; fixed value that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths to a block of the suffix sums.
SPAN = 4096


class Encoder:
    """Byte-pair encoder made from rank lines; workers build it once."""

    def __init__(self, lines: bytes, pattern: str = PATTERN) -> None:
        self.lines, self.pattern, self._made = lines, pattern, None

    def __getstate__(self) -> dict:
        return {"lines": self.lines, "pattern": self.pattern, "_made": None}

    def encode(self, text: str | None) -> list[int]:
        if self._made is None:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.lines.splitlines())}
            self._made = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._made.encode_ordinary(text) if text else []


def read_encoder(path: str = RANKS) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def token_lengths(docs: DataFrame, encoder: Encoder, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and n_tokens of each document."""
    held = docs.sparkSession.sparkContext.broadcast(encoder)
    rows = docs.select(*keep, F.col(text_col).alias("text_"))
    last = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(held.value.encode(t.as_py())) for t in b.column(last)]
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return map_batches(rows, run, with_field(docs.select(*keep).schema, "n_tokens", LongType()))


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): exact, pre-aggregated in each task. Written, as it is read more than once but texts should be
    encoded once."""
    return written(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "length-histogram")


def limit_table(hist: DataFrame, span: int = SPAN) -> DataFrame:
    """For each length L of the histogram as context limit: documents of just that length, documents and tokens
    beyond it, tokens in all, tokens left after cutting at L, and the share of documents that fit."""
    rows = hist.withColumns({"block": F.expr(f"n_tokens div {span}"), "tokens": F.col("n_tokens") * F.col("n_docs")})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs_"), F.sum("tokens").alias("tokens_"))
    over = Window.orderBy(F.desc("block"))  # a row for each block of lengths that occurs
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("docs_").over(before), F.lit(0)).alias("docs_later"),
                           F.coalesce(F.sum("tokens_").over(before), F.lit(0)).alias("tokens_later"),
                           F.sum("docs_").over(whole).alias("docs_all"), F.sum("tokens_").over(whole).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(blocks, "block").select(
        F.col("n_tokens").alias("context_limit"), "n_docs", "docs_all", "tokens_total",
        (F.col("docs_later") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_later") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_longer"))
    return rows.select("context_limit", "n_docs", "docs_longer", "tokens_longer", "tokens_total",
                       (F.col("tokens_total") - F.col("tokens_longer")
                        + F.col("context_limit") * F.col("docs_longer")).alias("tokens_truncated"),
                       (1 - F.col("docs_longer") / F.col("docs_all")).alias("share_fitting"))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """Documents and tokens beyond any given limits, and tokens left after cutting, from the limit table."""
    wanted = F.explode(F.lit(sorted(set(limits))).cast("array<long>"))
    below = F.col("context_limit") <= F.col("limit")
    # The last length within the limit has the answer; without one all documents are longer.
    pairs = table.withColumn("limit", wanted)
    total_docs = F.sum("n_docs")
    best = F.max(F.when(below, F.struct("context_limit", "docs_longer", "tokens_longer")))
    out = pairs.groupBy("limit").agg(best.alias("b"), total_docs.alias("docs"), F.max("tokens_total").alias("tokens"))
    longer, beyond = F.coalesce("b.docs_longer", "docs"), F.coalesce("b.tokens_longer", "tokens")
    return out.select("limit", longer.alias("docs_longer"), beyond.alias("tokens_longer"),
                      (F.col("tokens") - beyond + F.col("limit") * longer).alias("tokens_truncated"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of documents fits in."""
    wanted = F.explode(F.lit(shares).cast("array<double>"))
    return (table.withColumn("share", wanted).where(F.col("share_fitting") >= F.col("share"))
            .groupBy("share").agg(F.min("context_limit").alias("n_tokens")))
