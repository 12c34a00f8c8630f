"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from leadlens.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(rows, cosine=E.MIN_COSINE):
    ok = [label is not None and v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
          for _, v, label in rows]
    units = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if o else None
             for o, (_, v, _) in zip(ok, rows, strict=True)]
    root, n_links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j])
                    and units[i] @ units[j] >= cosine):
                n_links[i] += 1
                n_links[j] += 1
                root[find(i)] = find(j)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((vec_id, n_links[i], component, vec_id == component))
    return sorted(out, key=repr)


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    out = E.near_vectors(df, **more).collect()
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=repr)


def vectors(seed, n, labels, wide=8, near=0.2):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 6 + 1, wide))
    return [(i, (centres[draw.integers(len(centres))] + near * draw.normal(size=wide)).tolist(), f"l{draw.integers(labels)}")
            for i in range(n)]


@pytest.mark.parametrize("block", [E.BLOCK, 9])
def test_matches_all_pairs(spark, block):
    """Blocks of nine make many blocks, several levels of intervals and labels that span blocks."""
    rows = vectors(1, 400, 3)
    got = result(spark, rows, block=block)
    assert got == brute(rows)
    assert sum(n for _, n, _, _ in got) > 400


def test_one_dense_label(spark):
    rows = vectors(2, 300, 1, near=0.02)
    rows += [(1000 + i, rows[i % 3][1], "l0") for i in range(60)]  # copies of three vectors
    assert result(spark, rows, block=16) == brute(rows)


def test_broken_vectors_and_ids(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, "a"), (2, v, "a"), (3, v, None), (4, None, "a"), (5, [], "a"), (6, [0.0, 0.0, 0.0], "a"), (7, [nan, 1.0, 2.0], "a"),
            (8, [1.0, None, 2.0], "a"), (9, [inf, 1.0, 2.0], "a"), (10, [1.0, 2.0], "a"), (11, [1.0, 2.0], "a"), (12, v, "b"),
            (None, v, "b"), (None, [-1.0, 0.0, 0.0], "b"), (2, [2.0, 4.0, 6.0], "a"), (13, [1e-38, 0.0, 0.0], "c"),
            (14, [1e38, 0.0, 0.0], "c"), (15, [-0.0, 1.0, 0.0], "d"), (16, [0.0, 1.0, 0.0], "d")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_parts_join_rows_through_columns():
    links = np.zeros((4, 3), bool)
    links[0, 0] = links[1, 0] = links[1, 1] = links[3, 2] = True
    rows, cols = E.parts(links)
    assert rows.tolist() == [0, 0, -1, 3] and cols.tolist() == [0, 0, 3]


def test_distant_intervals_are_skipped(spark):
    """Far groups in one label: pairs of blocks grow with the blocks, not with their square."""
    draw = np.random.default_rng(5)
    centres = np.eye(8)
    rows = [(i, (centres[i % 8] + 0.01 * draw.normal(size=8)).tolist(), "l") for i in range(640)]
    df = spark.createDataFrame(rows, SCHEMA)
    eps = float(np.sqrt(2 - 2 * E.MIN_COSINE))
    numbered = E._numbered(df, "embedding", "vec_id", "label")
    blocks = E.written(E._blocks(E._classes(numbered, np.float32, eps, 8), 10), "test-blocks")
    n = blocks.count()
    pairs = E.block_pairs(blocks, 8, eps).count()
    assert n >= 64 and pairs < n * (n + 1) / 2 / 4
