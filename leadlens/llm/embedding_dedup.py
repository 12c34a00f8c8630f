"""Embedding near-duplicates by an epsilon grid order join.

Two vectors of one label link when their cosine, in double precision, reaches a threshold t. For unit vectors that is
a distance of at most eps = sqrt(2 - 2 t), and a projection on orthonormal axes never lengthens a distance. So:

1. Copies (same label, same entries) become one class with a count.
2. The leading principal axes come from the centred scatter of all unit vectors. Classes are sorted by length, label and
   the cells, eps wide, of their coordinates on those axes (range partitioned, so a label with a third of all rows lies
   in many partitions), and the sequence is cut into blocks of at most ``block`` classes.
3. The sequence is joined with itself interval by interval: a pair of intervals is dropped when their lengths or labels
   can't meet or when the boxes around their coordinates are more than eps apart, and else divided, FAN by FAN, down to
   pairs of blocks. Only pairs that survive are divided; each level is a join of two tables of intervals.
4. A pair of blocks is divided further in the same way, down to LEAF classes, whose cosines are one matrix product.

A pair of blocks reports, for each class that has links there, its number of links and the first class of its connected
part, never the links themselves: a dense group of k classes costs k rows per pair of blocks. Those parts are merged by
connected components over the written table.

Edge cases: null, empty and zero vectors, vectors with null or non-finite entries and rows without a label link with
nothing; vectors of different lengths never link; copies of a row are vectors of their own, linked with each other; null
ids never become a component_id unless the whole group has none, and a row without an id is kept only then; rows that
share the least id of a group are all kept, as the rule compares ids; an empty table gives an empty result; other columns
are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .whitening import principal, summed

MIN_COSINE = 0.93
#: Leading principal axes of the grid; classes in a block; intervals that an interval is divided into; classes in a leaf.
AXES, BLOCK, FAN, LEAF = 8, 1024, 8, 128
#: Distances are compared with eps + SLACK, so rounding can't drop a link.
SLACK = 1e-9


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length one; scaled first, so that squares neither overflow nor vanish."""
    v = raw.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _numbered(vectors: DataFrame, vec_col: str, id_col: str, label_col: str) -> DataFrame:
    """(rid, vec_id, label, raw binary, digest): raw and digest are null where the vector can't link."""
    kind = _dtype(vectors, vec_col)
    spelled = "float" if kind is np.float32 else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, digests = [], []
            for label, vector in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                held = None
                if label is not None and vector.is_valid and len(vector) and not vector.values.null_count:
                    v = vector.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # -0.0 becomes 0.0
                    held = v if np.isfinite(v).all() and v.any() else None
                raws.append(None if held is None else held.tobytes())
                digests.append(None if held is None else hashlib.sha256(
                    f"{len(held)}:{label}".encode("utf-8", "surrogatepass") + b"\0" + raws[-1]).digest())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raws, pa.binary()), pa.array(digests, pa.binary())],
                                             names=["rid", "vec_id", "label", "raw", "digest"])

    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"),
                          F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(f"array<{spelled}>").alias("v"))
    return written(rows.mapInArrow(run, "rid long, vec_id long, label string, raw binary, digest binary"), "vectors")


def _dtype(vectors: DataFrame, vec_col: str) -> type:
    return np.float32 if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else np.float64


def _axes(rows: DataFrame, width: int, kind: type, axes: int) -> np.ndarray:
    """The leading principal axes of the unit vectors with ``width`` entries (columns). Any axes give right results."""
    units = rows.where(F.length("raw") == width * kind().itemsize).select("raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit(np.frombuffer(b"".join(b.column(0).to_pylist()), kind).reshape(-1, width))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, width), pa.int32()), pa.array(u.ravel()))], names=["u"])

    u = units.mapInArrow(run, "u array<double>")
    n = units.count()
    mean = summed(u, lambda held: held.sum(0), width) / n
    return principal(summed(u, lambda held: (held - mean).T @ (held - mean), width * width).reshape(width, width))[1][:, :axes]


def _classes(rows: DataFrame, kind: type, eps: float, axes: int) -> DataFrame:
    """(rep, copies, label, width, raw, cell array<int>, at array<double>) per class of copies."""
    size = kind().itemsize
    held = rows.where("digest is not null")
    classes = written(held.groupBy("digest").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                                 F.first("label").alias("label"), F.first("raw").alias("raw")), "classes")
    top = (classes.groupBy(F.length("raw").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
           .orderBy(F.desc("rows"), F.desc("bytes")).limit(1).collect())
    width = top[0].bytes // size if top else 0
    basis = _axes(classes, width, kind, axes) if top else np.zeros((0, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.zeros((b.num_rows, axes))
            widths = []
            for i, raw in enumerate(b.column(3).to_pylist()):
                u = unit(np.frombuffer(raw, kind).reshape(1, -1))[0]
                p = u @ basis if len(u) == width else u[:axes]  # other lengths: their own first entries
                at[i, :len(p)] = p
                widths.append(len(u))
            cell = np.floor(at / eps).astype(np.int32)
            cuts = pa.array(np.arange(0, at.size + 1, axes), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(widths, pa.int32()), pa.ListArray.from_arrays(cuts, pa.array(cell.ravel())),
                 pa.ListArray.from_arrays(cuts, pa.array(at.ravel()))],
                names=["rep", "copies", "label", "raw", "width", "cell", "at"])

    return classes.select("rep", "copies", "label", "raw").mapInArrow(
        run, "rep long, copies long, label string, raw binary, width int, cell array<int>, at array<double>")


BLOCK_SCHEMA = ("pid int, k long, width int, label_lo string, label_hi string, lo array<double>, hi array<double>, "
                "reps array<long>, copies array<long>, labels array<string>, raws binary, ats array<double>")


def _blocks(classes: DataFrame, block: int) -> DataFrame:
    """The sequence in blocks: one row each, numbered by ``seq`` without gaps in the order of the grid."""

    def cut(pid: int, k: int, held: list[tuple]) -> list:
        at = np.array([h[5] for h in held])
        labels = [h[2] for h in held]
        return [pid, k, held[0][4], labels[0], labels[-1], at.min(0).tolist(), at.max(0).tolist(), [h[0] for h in held],
                [h[1] for h in held], labels, b"".join(h[3] for h in held), at.ravel().tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, k = None, [], 0

        def out(row: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema, strict=True)], names=BLOCK_NAMES)

        schema = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()),
                  pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()),
                  pa.binary(), pa.list_(pa.float64())]
        pid = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pid = row[6]
                if held and (len(held) == block or held[0][4] != row[4]):
                    yield out(cut(pid, k, held))
                    held, k = [], k + 1
                held.append(row)
        if held:
            yield out(cut(pid, k, held))

    order = ["width", "label", "cell", "rep"]
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = classes.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "rep", "copies", "label", "raw", "width", "at", F.spark_partition_id().alias("pid"))
    blocks = written(laid.mapInArrow(run, BLOCK_SCHEMA), "blocks")
    # One number per partition of the sequence reaches the driver.
    counts = {r.pid: r.n for r in blocks.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for pid in sorted(counts):
        starts.append((pid, before))
        before += counts[pid]
    starts = F.broadcast(blocks.sparkSession.createDataFrame(starts, "pid int, start long"))
    return blocks.join(starts, "pid").withColumn("seq", F.col("start") + F.col("k")).drop("pid", "k", "start")


BLOCK_NAMES = [part.split()[0] for part in BLOCK_SCHEMA.split(", ")]


def _intervals(blocks: DataFrame, axes: int) -> list[DataFrame]:
    """Intervals of the sequence per level, finest first: (seq, width range, label range, box)."""
    now = written(blocks.select("seq", F.col("width").alias("w_lo"), F.col("width").alias("w_hi"), "label_lo", "label_hi",
                                *(F.col("lo")[i].alias(f"lo{i}") for i in range(axes)),
                                *(F.col("hi")[i].alias(f"hi{i}") for i in range(axes))), "intervals")
    levels = [now]
    most = now.agg(F.max("seq")).first()[0] or 0
    while most:
        most //= FAN
        now = now.withColumn("seq", F.expr(f"seq div {FAN}")).groupBy("seq").agg(
            F.min("w_lo").alias("w_lo"), F.max("w_hi").alias("w_hi"), F.min("label_lo").alias("label_lo"),
            F.max("label_hi").alias("label_hi"), *(F.min(f"lo{i}").alias(f"lo{i}") for i in range(axes)),
            *(F.max(f"hi{i}").alias(f"hi{i}") for i in range(axes)))
        now = written(now, "intervals")
        levels.append(now)
    return levels


def _near(axes: int, eps: float) -> Column:
    """Intervals a and b may hold a link: their lengths and, in one length, labels meet, and their boxes are near."""
    apart = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.col(f"b.lo{i}") - F.col(f"a.hi{i}")),
                       F.lit(2.0)) for i in range(axes)), F.lit(0.0))
    one = (F.col("a.w_lo") == F.col("a.w_hi")) & (F.col("b.w_lo") == F.col("b.w_hi"))
    meet = (F.col("a.w_lo") <= F.col("b.w_hi")) & (F.col("b.w_lo") <= F.col("a.w_hi"))
    labels = (F.col("a.label_lo") <= F.col("b.label_hi")) & (F.col("b.label_lo") <= F.col("a.label_hi"))
    return meet & (~one | labels) & (apart <= (eps + SLACK) ** 2)


def block_pairs(blocks: DataFrame, axes: int, eps: float) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks that may hold links, by dividing pairs of intervals level by level."""
    levels = _intervals(blocks, axes)
    pairs = levels[-1].select(F.col("seq").alias("a"), F.col("seq").alias("b"))  # the whole sequence with itself
    for level in reversed(levels[:-1]):
        upper = pairs.withColumnsRenamed({"a": "ua", "b": "ub"})
        a = level.withColumn("up", F.expr(f"seq div {FAN}")).alias("a")
        b = level.withColumn("up", F.expr(f"seq div {FAN}")).alias("b")
        pairs = written(upper.join(a, F.col("ua") == F.col("a.up")).join(
            b, (F.col("ub") == F.col("b.up")) & (F.col("a.seq") <= F.col("b.seq")) & _near(axes, eps))
            .select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b")), "interval-pairs")
    return pairs


def _distant(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0.0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) > (eps + SLACK) ** 2


def linked(a: tuple, b: tuple, same: bool, cosine: float, eps: float) -> np.ndarray:
    """Boolean matrix of the links between two blocks (units, coordinates, label numbers), by dividing intervals."""
    out = np.zeros((len(a[0]), len(b[0])), bool)
    todo = [(0, len(a[0]), 0, len(b[0]))]
    while todo:
        i, j, k, m = todo.pop()
        if same and m <= i:  # below the diagonal of a block with itself
            continue
        if a[2][j - 1] < b[2][k] or b[2][m - 1] < a[2][i] or _distant(a[1][i:j], b[1][k:m], eps):
            continue
        if j - i <= LEAF and m - k <= LEAF:
            out[i:j, k:m] = (a[0][i:j] @ b[0][k:m].T >= cosine) & (a[2][i:j, None] == b[2][None, k:m])
        elif j - i >= m - k:
            half = (i + j) // 2
            todo += [(i, half, k, m), (half, j, k, m)]
        else:
            half = (k + m) // 2
            todo += [(i, j, k, half), (i, j, half, m)]
    if same:
        np.fill_diagonal(out, False)
        out = np.triu(out)
        out |= out.T
    return out


def parts(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each row's and each column's connected part in a bipartite link matrix; -1 without links."""
    rows, cols = np.full(links.shape[0], -1), np.full(links.shape[1], -1)
    for start in np.flatnonzero(links.any(1)).tolist():
        if rows[start] >= 0:
            continue
        rows[start], edge = start, np.array([start])
        while len(edge):
            reached = np.flatnonzero(links[edge].any(0) & (cols < 0))
            cols[reached] = start
            edge = np.flatnonzero(links[:, reached].any(1) & (rows < 0))
            rows[edge] = start
    return rows, cols


def class_links(blocks: DataFrame, pairs: DataFrame, kind: type, axes: int, cosine: float, eps: float) -> DataFrame:
    """(rep, root, n): of each pair of blocks, per linked class the vectors it links and the first class of its part."""

    def side(b: pa.RecordBatch, row: int, at: int) -> tuple:
        reps, copies, labels = (b.column(at + c)[row].as_py() for c in range(3))
        raw = np.frombuffer(b.column(at + 3)[row].as_py(), kind).reshape(len(reps), -1)
        where = np.array(b.column(at + 4)[row].values.to_numpy()).reshape(len(reps), axes)
        return np.array(reps), np.array(copies), labels, unit(raw), where

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                x, y = side(b, row, 2), side(b, row, 7)
                same = b.column(0)[row].as_py() == b.column(1)[row].as_py()
                # Both blocks are sorted by label in code point order, so numbers in that order keep them sorted.
                number = {v: i for i, v in enumerate(sorted({*x[2], *y[2]}, key=lambda v: v.encode("utf-8", "surrogatepass")))}
                left, right = (np.array([number[v] for v in s[2]]) for s in (x, y))
                links = linked((x[3], x[4], left), (y[3], y[4], right), same, cosine, eps)
                # A block with itself: a class is one and the same as row and as column.
                row_part, col_part = parts(links | np.diag(links.any(1)) if same else links)
                found = [(x[0], row_part, links @ y[1])]
                if not same:
                    found.append((y[0], col_part, links.T @ x[1]))
                for reps, part, n in found:
                    has = part >= 0
                    if has.any():
                        yield pa.RecordBatch.from_arrays([pa.array(reps[has]), pa.array(x[0][part[has]]),
                                                          pa.array(n[has].astype(np.int64))], names=["rep", "root", "n"])

    payload = ["reps", "copies", "labels", "raws", "ats"]
    a = blocks.select(F.col("seq").alias("a"), *(F.col(c).alias(f"a_{c}") for c in payload))
    b = blocks.select(F.col("seq").alias("b"), *(F.col(c).alias(f"b_{c}") for c in payload))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", *(f"a_{c}" for c in payload), *(f"b_{c}" for c in payload))
    return written(both.mapInArrow(run, "rep long, root long, n long"), "class-links")


def near_vectors(vectors: DataFrame, cosine: float = MIN_COSINE, block: int = BLOCK, axes: int = AXES,
                 vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    kind = _dtype(vectors, vec_col)
    rows = _numbered(vectors, vec_col, id_col, label_col)
    classes = _classes(rows, kind, eps, axes)
    blocks = written(_blocks(classes, block), "numbered-blocks")
    found = class_links(blocks, block_pairs(blocks, axes, eps), kind, axes, cosine, eps)
    degrees = found.groupBy("rep").agg(F.sum("n").alias("others"))
    roots = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    own = rows.where("digest is not null").groupBy("digest").agg(
        F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    own = written(own.join(degrees, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", "least", F.coalesce("root", "rep").alias("root"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "class-groups")
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    own = own.join(least, "root").select("digest", "n_links", "component_id")
    found = rows.select("vec_id", "digest").join(own, "digest", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
