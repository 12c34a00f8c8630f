"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint bit is set when more than half of the text's word shingles have it in their XXH64 (seed 42).
Fingerprints that differ in at most ``max_bits`` bits are linked; groups are the connected components.

Search: the 64 bits are dealt into groups so that correlated bits, which add little selectivity to each other, sit
together. If two fingerprints differ in at most t bits, then for any thresholds t_i >= -1 with sum(t_i) = t - groups + 1
some group differs in at most t_i bits (-1 leaves a group out). Dynamic programming picks the thresholds with the least
estimated work: probes to send plus candidates to verify, the latter from collision counts over all fingerprints; the
number of groups is the one whose best thresholds cost least, so it follows the number of fingerprints. One table is
indexed by each group's bits, every fingerprint probes all values within t_i flips, and each candidate is verified on the
whole 64 bits inside the join.

Copies share a fingerprint, and only distinct fingerprints are searched, so groups of copies cost one row. Pairs of near
fingerprints are never listed: first each fingerprint is compared with the least and the greatest of its bucket in each
group, and those links are merged into clusters; then the search reports only which clusters are linked, each pair of
clusters once a task, and merges those. A dense group is one cluster after the first step.

Edge cases: null, empty and word-less texts have fingerprint zero and are linked like any other; fewer words than
a shingle give one shingle of them all; repeated shingles count each time; null ids never become a component_id
unless the whole group has no id; repeated rows stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, map_batches, own_columns, written
from .components import components

SHINGLE_WORDS, MAX_BITS = 4, 4
#: Work of verifying a candidate, with sending one probe as 1.
CANDIDATE_COST = 0.1
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text; memory beyond its words is bounded by BLOCK shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()  # bytes split on \x20 \x09-\x0D
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), len(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[:max(1, n - words + 1)], ends[min(words, n) - 1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in
                           zip(starts[at:at + BLOCK].tolist(), ends[at:at + BLOCK].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, text_col: str = "text",
                 id_col: str = "doc_id", row_col: str | None = None) -> DataFrame:
    """(doc_id, fp) and, of documents with a ``row_col``, rid: fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            own = [b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(own, names=["doc_id", "fp", "rid"][:len(own)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       *([F.col(row_col).alias("rid")] if row_col else []))
    return map_batches(rows, run, "doc_id long, fp long" + (", rid long" if row_col else ""))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and the 64 x 64 counts of bits set together, over all rows.

    Each task sends one matrix; the driver gets 4,096 sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for b in batches:
            raw = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(raw), BLOCK):
                bits = np.unpackbits(raw[at:at + BLOCK], axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel().astype(np.int64))],
                                         names=["cell", "n"])

    rows = (fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
            .collect())
    together = np.zeros(4096)
    for r in rows:
        together[r.cell] = r.n
    return fps.count(), together.reshape(64, 64)


def bit_groups(n: int, together: np.ndarray, parts: int = 3) -> list[list[int]]:
    """Deal the bits into groups of near-equal size, each grown around its most correlated bits."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        group = [left[int(np.argmax(corr[np.ix_(left, left)].sum(1)))]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(1)))])
        left = [b for b in left if b not in group]
        groups.append(sorted(group))
    return groups


def probes(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def cheapest(widths: list[int], candidates: list[list[float]], n: int, max_bits: int = MAX_BITS) -> tuple[float, list[int]]:
    """(work, thresholds t_i >= -1 summing to max_bits - groups + 1) with the least probes plus candidates.

    candidates[i][t]: estimated pairs within t bits in group i.
    """
    want = max_bits - len(widths) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the sum so far
    for width, pairs in zip(widths, candidates, strict=True):
        grown: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, min(max_bits, width) + 1):
                work = cost + (0 if t < 0 else n * probes(width, t) + CANDIDATE_COST * pairs[t])
                if total + t not in grown or work < grown[total + t][0]:
                    grown[total + t] = (work, [*chosen, t])
        best = grown
    return best[want]


def thresholds(widths: list[int], candidates: list[list[float]], n: int, max_bits: int = MAX_BITS) -> list[int]:
    return cheapest(widths, candidates, n, max_bits)[1]


def plan_search(fps: DataFrame, parts: int | None = None, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group, from statistics over all distinct fingerprints; ``parts`` groups, by default as
    many as cost least."""
    n, together = bit_statistics(fps)
    options = [parts] if parts else list(range(2, max_bits + 2))
    dealt = {k: bit_groups(n, together, k) for k in options}
    places = [(k, i) for k in options for i in range(k)]
    keys = F.explode(F.array(*[F.struct(F.lit(at).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(dealt[k][i]))).alias("key"))
                               for at, (k, i) in enumerate(places)])).alias("k")
    same = {places[r.part]: r.pairs for r in fps.select(keys).groupBy("k.part", "k.key").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("part").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect()}
    p = np.diag(together) / max(n, 1)
    found = []
    for k in options:
        candidates = []
        for i, g in enumerate(dealt[k]):
            at = np.zeros(len(g) + 1)  # chance of each distance, bits taken as independent
            at[0] = 1.0
            for b in g:
                differ = 2 * p[b] * (1 - p[b])
                at[1:], at[0] = at[1:] * (1 - differ) + at[:-1] * differ, at[0] * (1 - differ)
            within = np.cumsum(at)
            measured = max(float(same.get((k, i)) or 0), 1.0)
            candidates.append([measured * within[min(t, len(g))] / max(within[0], 1e-30) for t in range(max_bits + 1)])
        work, chosen = cheapest([len(g) for g in dealt[k]], candidates, max(n, 1), max_bits)
        found.append((work, k, list(zip(dealt[k], chosen, strict=True))))
    return min(found)[2]


def _mask(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def _probes(part: int, key: Column, flips: list[int]) -> Column:
    return F.transform(F.lit(flips).cast("array<long>"), lambda flip: F.struct(
        F.lit(part).cast("byte").alias("part"), key.bitwiseXOR(flip).alias("key")))


def _index(plan: list[tuple[list[int], int]]) -> Column:
    """(part, key) of a fingerprint in each group that is not left out."""
    return F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("key"))
                               for i, (bits, radius) in enumerate(plan) if radius >= 0])).alias("k")


def links(fps: DataFrame, plan: list[tuple[list[int], int]], max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): every pair of clusters with distinct fingerprints (columns fp, unique, and cluster) that differ in at most
    max_bits bits, once."""
    probing = []
    for i, (bits, radius) in enumerate(plan):
        if radius >= 0:
            flips = [_mask(list(c)) for k in range(radius + 1) for c in combinations(bits, k)]
            probing.append(_probes(i, F.col("fp").bitwiseAND(F.lit(_mask(bits))), flips))
    held = fps.select(F.col("fp").alias("b"), F.col("cluster").alias("cluster_b"), _index(plan)).select(
        "k.part", "k.key", "b", "cluster_b")
    sent = (fps.select(F.col("fp").alias("a"), F.col("cluster").alias("cluster_a"), F.explode(F.concat(*probing)).alias("k"))
            .select(F.col("k.part").alias("part_"), F.col("k.key").alias("key_"), "a", "cluster_a"))
    near = ((F.col("cluster_a") != F.col("cluster_b")) & (F.col("a") < F.col("b"))
            & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    found = sent.join(held, (F.col("part_") == F.col("part")) & (F.col("key_") == F.col("key")) & near)
    # Grouped in each task before the shuffle: pairs of one pair of clusters are one row.
    return found.select(F.least("cluster_a", "cluster_b").alias("a"), F.greatest("cluster_a", "cluster_b").alias("b")).distinct()


def bucket_links(fps: DataFrame, plan: list[tuple[list[int], int]], max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): fingerprints with the least and the greatest of their buckets, where they differ in at most max_bits bits.
    At most two rows for each fingerprint and group."""
    rows = fps.select("fp", _index(plan)).select("fp", "k.part", "k.key")
    ends = rows.groupBy("part", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select(
        F.col("part").alias("part_"), F.col("key").alias("key_"), F.array("low", "high").alias("ends"))
    met = rows.join(ends, (F.col("part_") == F.col("part")) & (F.col("key_") == F.col("key"))).select(
        F.col("fp").alias("a"), F.explode("ends").alias("b"))
    return met.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))


def clusters(fps: DataFrame, max_bits: int = MAX_BITS, parts: int | None = None) -> DataFrame:
    """fps (column fp, unique, and others) with ``cluster``: a fingerprint that stands for all that links reach."""
    plan = plan_search(fps, parts, max_bits)

    def merged(rows: DataFrame, edges: DataFrame, key: str, name: str) -> DataFrame:
        roots = components(edges).select(F.col("node").alias("node_"), "root")
        return written(rows.join(roots, F.col(key) == F.col("node_"), "left").withColumn(
            "cluster", F.coalesce("root", key)).drop("node_", "root"), name)

    near = merged(fps, bucket_links(fps, plan, max_bits), "fp", "bucket-clusters")
    return merged(near, links(near, plan, max_bits), "cluster", "clusters")


def fingerprint_groups(rows: DataFrame, least: Column, max_bits: int, parts: int | None) -> DataFrame:
    """(fp, least): the least value of the aggregate ``least`` among all rows that links reach, the own ones included."""
    fps = written(rows.groupBy("fp").agg(least.alias("own_least")), "distinct-fingerprints")
    linked = clusters(fps, max_bits, parts)
    leasts = linked.groupBy("cluster").agg(F.min("own_least").alias("least"))
    return written(linked.join(leasts, "cluster").select("fp", "least"), "fingerprint-components")


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, parts: int | None = None,
                   text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fp, component_id (least doc_id that links reach, its own included)."""
    rows = written(fingerprints(docs, words, text_col, id_col), "fingerprints")
    ids = fingerprint_groups(rows, F.min("doc_id"), max_bits, parts)
    return rows.join(ids, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def near_dedup(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, text_col: str = "text",
               id_col: str = "doc_id") -> DataFrame:
    """The documents without near copies: of each group the row with the least doc_id stays, with its columns.

    Rows are told apart by a number of their own: of a group's rows that share the least id one stays, and rows of
    different groups stay even where they share an id. Rows without an id stay, as no id says which of them would go.
    """
    rid, gone = own_columns(docs, "rid", "gone_rid")
    # Written, as a row must have the same number in both passes.
    numbered = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered-documents")
    rows = written(fingerprints(numbered, words, text_col, id_col, rid), "fingerprints")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rid")))
    first = fingerprint_groups(rows, least, max_bits, None).select("fp", F.col("least.rid").alias("first_rid"))
    copies = rows.where("doc_id is not null").join(first, "fp").where("rid <> first_rid")
    copies = written(copies.select(F.col("rid").alias(gone)), "near-copies")
    # Merged at any size: whether the numbers would fit a broadcast grows with the corpus.
    return numbered.join(copies.hint("merge"), F.col(rid) == F.col(gone), "left_anti").drop(rid)
