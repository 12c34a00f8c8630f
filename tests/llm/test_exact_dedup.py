import hashlib
from collections import defaultdict

from helpers import docs

from leadlens.llm.exact_dedup import digests, exact_dedup, misra_gries


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(i)
    out = []
    for i, t in rows:
        d = hashlib.sha256(lower(t).encode()).hexdigest()
        keep = max((x for x in groups[d] if x is not None), default=None)
        out.append((i, keep, len(groups[d]), d))
    return sorted(out, key=repr)


def check(spark, rows, counters):
    got = exact_dedup(docs(spark, *rows), counters=counters).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got), key=repr) == brute(rows)
    kept = defaultdict(int)
    for r in got:
        kept[bytes(r.digest)] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1}


def test_groups_with_and_without_heavy_hitters(spark):
    rows = ([(i, "Same TEXT") for i in range(60)] + [(100 + i, f"text {i % 7}") for i in range(30)]
            + [(200, None), (201, ""), (202, "É"), (203, "é"), (204, "x" * 200_000), (205, "X" * 200_000),
               (206, "dup"), (206, "dup"), (None, "no id"), (None, "no id"), (300, "NO ID")])
    check(spark, rows, 1000)
    check(spark, rows, 2)


def test_misra_gries_holds_every_frequent_digest(spark):
    rows = docs(spark, *[(i, "hot") for i in range(40)], *[(100 + i, "warm") for i in range(30)],
                *[(1000 + i, f"cold {i}") for i in range(50)])
    found = misra_gries(digests(rows.repartition(5)), counters=3)
    assert len(found) <= 3
    assert {hashlib.sha256(t).digest() for t in (b"hot", b"warm")} <= set(found)


def test_empty_table_and_clashing_columns(spark):
    assert exact_dedup(docs(spark)).count() == 0
    odd = docs(spark, (1, "a"), (2, "a")).selectExpr("*", "1 as digest", "2 as rid", "3 as keep_id", "4 as group_size")
    assert [(r.doc_id, r.keep_id) for r in exact_dedup(odd).orderBy("doc_id").collect()] == [(1, 2), (2, 2)]
