import random
import re

import numpy as np
import xxhash
from helpers import docs, words

from leadlens.llm import simhash as S
from leadlens.llm.components import components


def brute_fingerprint(text):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, fps, bits=4):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def sample():
    r = random.Random(3)
    rows = []
    for k in range(40):
        base = words(120, k)
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.randrange(4)):
            near = list(base)
            near[r.randrange(len(near))] = "changed"
            rows.append((len(rows), " ".join(near)))
    rows += [(500 + i, " ".join(words(90, 77))) for i in range(30)]
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "one"), (604, "One"), (605, "a b c"), (606, "a b c d"),
             (607, "ünïcode Éé " * 50), (608, "w " * 100_000), (609, "same"), (609, "same"), (None, "no id here at all"),
             (None, None), (610, "a\x0bb\x0cc d e"), (611, "a b c d e")]
    return rows


def test_fingerprints_equal_brute_force():
    for _, text in sample():
        if len(text or "") < 10_000:
            assert S.fingerprint(text) == brute_fingerprint(text), text


def test_fingerprint_blocks(monkeypatch):
    text = " ".join(words(400, 5))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "BLOCK", 17)
    assert S.fingerprint(text) == whole


def test_groups_equal_brute_force(spark):
    rows = sample()
    got = S.simhash_groups(docs(spark, *rows).repartition(4)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == brute_components(
        rows, [S.fingerprint(t) for _, t in rows])


def test_links_find_every_pair(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():  # neighbours at distances 1 to 6, with sign bits
        for k in range(1, 7):
            fps.add(f ^ sum(1 << int(b) for b in r.choice(64, k, replace=False)))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i)
            if (fps[i] ^ fps[j]).bit_count() <= 4}
    table = spark.createDataFrame([(x, x) for x in signed], "fp long, cluster long")
    for parts in (2, 3, 5):
        plan = S.plan_search(table, parts)
        assert sum(t for _, t in plan) == 4 - parts + 1 and sorted(b for g, _ in plan for b in g) == list(range(64))
        found = S.links(table, plan).collect()
        assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def brute_clusters(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    values = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 4).tolist():
            root[find(f)] = find(fps[j])
    return {frozenset(f for f in fps if find(f) == r) for r in {find(f) for f in fps}}


def test_dense_groups_give_linear_rows(spark):
    """2,000 fingerprints within two bits of one centre are all within four bits of each other: two million pairs."""
    r = np.random.default_rng(4)
    centre, other = (int(x) for x in r.integers(0, 1 << 63, 2, dtype=np.uint64))
    near = {centre ^ 1 << int(a) ^ 1 << int(b) for a in range(64) for b in range(a)}
    fps = sorted(near)[:2000] + [other ^ 1 << int(a) for a in range(40)] + r.integers(0, 1 << 63, 200, dtype=np.uint64).tolist()
    signed = {f: int(np.uint64(f).astype(np.int64)) for f in fps}
    table = spark.createDataFrame([(x,) for x in signed.values()], "fp long").repartition(4)
    for parts in (None, 3):
        plan = S.plan_search(table, parts)
        first = S.bucket_links(table, plan)
        assert first.count() <= 2 * len(plan) * len(fps)
        roots = {x.node: x.root for x in components(first).collect()}
        near_table = spark.createDataFrame([(x, roots.get(x, x)) for x in signed.values()], "fp long, cluster long")
        assert S.links(near_table, plan).count() <= len(fps)
        got = {}
        for x in S.clusters(table, parts=parts).collect():
            got.setdefault(x.cluster, set()).add(x.fp)
        want = {frozenset(signed[f] for f in c) for c in brute_clusters(fps)}
        assert {frozenset(c) for c in got.values()} == want


def test_number_of_groups_follows_the_cost(spark):
    r = np.random.default_rng(6)
    table = spark.createDataFrame([(int(x),) for x in r.integers(-(1 << 62), 1 << 62, 3000)], "fp long")
    assert len(S.plan_search(table)) == 5  # few fingerprints: one probe a group is cheapest
    wide = [[5e17 / 2 ** w * S.probes(w, t) for t in range(5)] for w in (32, 32)]
    many = S.cheapest([32, 32], wide, 10 ** 9)[0]
    assert many < S.cheapest([13, 13, 13, 13, 12], [[5e17 / 2 ** w] * 5 for w in (13, 13, 13, 13, 12)], 10 ** 9)[0]


def test_thresholds_take_the_cheapest_split():
    cheap, dear = [0, 1, 2, 3, 4], [1e9] * 5
    assert S.thresholds([21, 21, 22], [cheap, dear, dear], n=1)[0] == 4  # the others are left out
    assert sum(S.thresholds([32, 32], [cheap, cheap], n=10)) == 3


def test_correlated_bits_sit_together():
    r = np.random.default_rng(0)
    bits = r.integers(0, 2, (4000, 64)).astype(float)
    bits[:, 40], bits[:, 63] = bits[:, 3], bits[:, 3]
    groups = S.bit_groups(4000, bits.T @ bits)
    assert any({3, 40, 63} <= set(g) for g in groups)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark):
    rows = [(1, " ".join(words(200, 1))), (2, " ".join(words(200, 1))), (3, " ".join(words(200, 2))), (3, " ".join(words(200, 2))),
            (4, None), (5, ""), (None, "free"), (None, "free")]
    odd = docs(spark, *rows).selectExpr("*", "1 as fp", "2 as gone_id", "3 as component_id")
    out = S.near_dedup(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == [1, 3, 4, None, None]


def test_near_dedup_decides_by_row_where_an_id_has_several_texts(spark):
    a, b, c, other = (" ".join(words(200, k)) for k in (1, 2, 3, 4))
    rows = [(3, b), (5, a), (5, b), (7, c), (7, other), (8, c), (9, a), (9, a)]
    out = S.near_dedup(docs(spark, *rows).repartition(3))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(3, b), (5, a), (7, c), (7, other)])


def test_empty_table(spark):
    assert S.simhash_groups(docs(spark)).count() == 0
    assert S.near_dedup(docs(spark)).count() == 0
