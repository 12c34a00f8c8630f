import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

from helpers import docs
from pyspark.sql import functions as F

from leadlens.llm import mixing as M


def fill(total, children):
    """children: {name: (capacity, weight)}; whole tokens, exhausted children first."""
    order = sorted(children, key=lambda c: (children[c][0] / children[c][1], c))
    taken, rest = {}, sum(w for _, w in children.values())
    for c in order:
        cap, w = children[c]
        left = total - sum(taken.values())
        if Fraction(cap * rest) > Fraction(w * left):
            break
        taken[c] = cap
        rest -= w
    left = total - sum(taken.values())
    return {c: taken.get(c, children[c][1] * left // rest if rest else 0) for c in children}


def budgets(supply, budget, epochs, weights):
    """supply: {(domain, lang, source): tokens}."""
    level = {(): budget}
    for depth in range(3):
        caps = defaultdict(int)
        for leaf, n in supply.items():
            caps[leaf[:depth + 1]] += n * epochs
        nxt = {}
        for parent, total in level.items():
            children = {k: (c, weights[depth](k[-1])) for k, c in caps.items() if k[:-1] == parent and c and weights[depth](k[-1])}
            nxt.update(fill(total, children))
        level = nxt
    return level


def brute(rows, budget, epochs, weights, domain, seed):
    toks = {id(r): len([w for w in (r[1] or "").replace("\n", " ").split(" ") if w]) for r in rows}
    leaves = defaultdict(list)
    for r in rows:
        leaves[domain(r[3]), r[2] or "", r[3] or ""].append(r)
    supply = {k: s for k, v in leaves.items() if (s := sum(toks[id(r)] for r in v))}
    plan = budgets(supply, sum(supply.values()) if budget is None else budget, epochs, weights)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    out = Counter()
    for leaf, b in plan.items():
        full, rest = divmod(b, supply[leaf])
        key = lambda r: md5(f"{full}:" + md5(f"{seed}:{'' if r[0] is None else r[0]}:{md5(r[1] or '')}"))  # noqa: B023,E731
        run = 0
        for r in sorted(leaves[leaf], key=key):
            run += toks[id(r)]
            for e in range(full + (run <= rest)):
                out[r[0], r[1], e] += 1
    return plan, out


def run(spark, rows, budget=None, epochs=3, weights=None, seed=42):
    weights = weights or (lambda d: {"d0": 2}.get(d, 1), lambda x: {"en": 4, "zz": 0}.get(x, 2), lambda s: 1)
    table = docs(spark, *rows).repartition(3)
    columns = (F.when(F.col("domain") == "d0", 2).otherwise(1),
               F.when(F.col("language") == "en", 4).when(F.col("language") == "zz", 0).otherwise(2), F.lit(1))
    domain = F.concat(F.lit("d"), F.length(F.coalesce("source", F.lit(""))) % 2)
    chosen, plan = M.mix(table, columns, domain, F.col("lang"), F.col("source"), budget=budget, max_epochs=epochs, seed=seed)
    want_plan, want = brute(rows, budget, epochs, weights, lambda s: f"d{len(s or '') % 2}", seed)
    assert {(r.domain, r.language, r.origin): r.budget for r in plan.collect()} == want_plan
    assert Counter((r.doc_id, r.text, r.epoch) for r in chosen.collect()) == want
    return chosen


def sample():
    r = random.Random(9)
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{r.randrange(12)}"
        rows.append((i, " ".join(["w"] * r.randrange(0, 40)), r.choice(["en", "en", "de", "fr"]), source, 1))
    return rows + [(1000, None, "en", "hot", 1), (1001, "", None, None, None), (1002, "a b", None, None, 1),
                   (1003, "x y z", "zz", "s1", 1), (1004, "big " * 20_000, "es", "s2", 1), (1005, "t t", "en", "s3", 1),
                   (1005, "t t", "en", "s3", 1), (None, "no id", "en", "s3", 1), (1006, "\n\n", "de", "only blank", 1)]


def test_equals_brute_force(spark):
    for budget in (None, 0, 1, 997, 10_000, 10_000_000):
        run(spark, sample(), budget)


def test_small_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_DIGITS", 1)
    monkeypatch.setattr(M, "BROADCAST_LEAVES", 0)
    run(spark, sample(), 5000, epochs=1)


def test_shortage_goes_to_siblings_before_ancestors():
    supply = {("a", "en", "x"): 10, ("a", "en", "y"): 1000, ("b", "en", "z"): 1000}
    one = [lambda _: 1] * 3
    assert budgets(supply, 400, 1, one) == {("a", "en", "x"): 10, ("a", "en", "y"): 190, ("b", "en", "z"): 200}
    supply["a", "en", "y"] = 40
    assert budgets(supply, 400, 1, one) == {("a", "en", "x"): 10, ("a", "en", "y"): 40, ("b", "en", "z"): 350}


def test_empty_table_and_clashing_names(spark):
    assert run(spark, []).count() == 0
    odd = docs(spark, (1, "a b")).selectExpr("*", "1 as epoch", "2 as domain", "3 as bucket", "4 as order_key")
    chosen, _ = M.mix(odd, (F.lit(1),) * 3, F.lit("d"), F.col("lang"), F.col("source"))
    assert chosen.columns == [*odd.columns, "epoch_", "domain_", "n_tokens"] and chosen.count() == 1
