import base64

import pytest
import regex
from helpers import docs

from leadlens.llm import token_counts as T

ENCODER = T.read_encoder()
TEXTS = ["Hello world, hello tokens!", "", None, "a" * 50_000, "naïve café 漢字 <|endoftext|>", "\n\n  \n", "x", "x", "one two three"] + [
    "word " * k for k in range(1, 40)]


@pytest.fixture(scope="module")
def lengths():
    return sorted(len(ENCODER.encode(t)) for t in TEXTS)


def table(spark, **kw):
    rows = docs(spark, *enumerate(TEXTS)).repartition(3)
    return T.limit_table(T.histogram(T.token_lengths(rows, ENCODER)), **kw)


def merged(piece, ranks):
    """Byte-pair merges one by one: the neighbours of the least rank first, the leftmost of equal ones."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        ranked = [(ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(ranked)
        if rank == len(ranks):
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_encoder_round_trips_and_equals_merge_loop():
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ENCODER.lines.splitlines())}
    for t in TEXTS:
        codes = ENCODER.encode(t)
        assert ENCODER._made is None or ENCODER._made.decode(codes) == (t or "")
        if t and len(t) < 200:
            assert ENCODER._made is not None
            assert codes == [c for piece in regex.findall(ENCODER.pattern, t) for c in merged(piece.encode(), ranks)]


def test_texts_are_encoded_once(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    plan = T.limit_table(T.histogram(T.token_lengths(rows, ENCODER)))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_table_equals_brute_force_for_any_block(spark, lengths):
    for span in (T.SPAN, 3):
        rows = table(spark, span=span).collect()
        assert sorted(r.context_limit for r in rows) == sorted(set(lengths))
        for r in rows:
            at = r.context_limit
            assert (r.n_docs, r.docs_longer, r.tokens_longer, r.tokens_total, r.tokens_truncated) == (
                lengths.count(at), sum(n > at for n in lengths), sum(n for n in lengths if n > at), sum(lengths),
                sum(min(n, at) for n in lengths))
            assert abs(r.share_fitting - sum(n <= at for n in lengths) / len(lengths)) < 1e-12


def test_every_limit_and_quantiles(spark, lengths):
    out = table(spark)
    limits = [0, 1, 2, 5, 7, 38, 100, 10**9]
    for r in T.at_limits(out, limits).collect():
        assert (r.docs_longer, r.tokens_longer, r.tokens_truncated) == (
            sum(n > r.limit for n in lengths), sum(n for n in lengths if n > r.limit), sum(min(n, r.limit) for n in lengths))
    got = {r.share: r.n_tokens for r in T.quantiles(out, [0.1, 0.5, 1.0]).collect()}
    for share, n in got.items():
        assert n == min(x for x in lengths if sum(y <= x for y in lengths) / len(lengths) >= share)


def test_empty_table_and_kept_columns(spark):
    assert T.limit_table(T.histogram(T.token_lengths(docs(spark), ENCODER))).count() == 0
    odd = docs(spark, (1, "x")).selectExpr("*", "5 as n_tokens", "6 as text_")
    assert T.token_lengths(odd, ENCODER, keep=("doc_id",)).collect()[0].asDict() == {"doc_id": 1, "n_tokens": 1}
