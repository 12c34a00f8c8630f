"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversation_repair import repair
from .decontamination import contamination
from .embedding_dedup import MIN_COSINE, near_vectors
from .exact_dedup import exact_dedup
from .langid import identify
from .line_dedup import dedup_lines, line_count
from .mixing import mix
from .secret_scan import (BASE_KINDS, KINDS, LIVE_DISTINCT, LIVE_LENGTH, MAX_OWNERS, MAX_REPOS, PLACEHOLDER,
                          secret_scan, span_list)
from .simhash import simhash_groups
from .token_counts import histogram, limit_table, read_encoder, token_lengths
from .toxicity import toxicity
from .url_templates import RULES, judge_urls
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op7_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


DOC_WORDS_SQL = f"regexp_extract_all({LOWER_SQL}, '" + r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" + "')"


@query("op1_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {DOC_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {DOC_WORDS_SQL} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
             array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS pattern
      FROM b, LATERAL unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
x AS (SELECT rid, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS pattern
      FROM d, (SELECT DISTINCT n FROM p) AS s, LATERAL unnest(range(1, len(w) - s.n + 2)) AS t(i)),
h AS (SELECT rid, i, n, item_id FROM x JOIN p USING (n, pattern)),
hits AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN found USING (rid)""")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


@query("op9_line_dedup", """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT rid, doc_id, text, i, array_to_string(l[i:i + 2], chr(10)) AS k
      FROM d, LATERAL unnest(range(1, len(l) - 1)) AS t(i)),
later AS (SELECT rid, i FROM w WHERE translate(k, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> ''
          QUALIFY rank() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, sha256(text), i) > 1),
covered AS (SELECT DISTINCT rid, unnest(range(i, i + 3)) AS pos FROM later),
lines AS (SELECT rid, i AS pos, l[i] AS line FROM d, LATERAL unnest(range(1, len(l) + 1)) AS t(i)),
kept AS (SELECT rid, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
         FROM lines ANTI JOIN covered USING (rid, pos) GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept USING (rid)""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", line_count("text").alias("n_lines")))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def registered_mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As many tokens as the documents have, at most three epochs of any source.

    Three domains, by the number in a source's name; weights 2, 1, 1. English weighs 4, other languages 2, sources 1.
    """
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)"), F.lit(0))
    weights = (F.when(F.col("domain") == "domain0", 2).otherwise(1),
               F.when(F.col("language") == "en", 4).otherwise(2), F.lit(1))
    return mix(docs, weights, F.concat(F.lit("domain"), number % 3), F.col("lang"), F.col("source"))


def _fill_sql(name: str, parent: str | None, on: list[str], child: str, weight: str) -> str:
    """One level of budgets: ``name``(on..., child, budget)."""
    keys = ", ".join([*on, child])
    part = f"PARTITION BY {', '.join(on)}" if on else ""
    total = "(SELECT sum(supply) FROM leaves)" if parent is None else f"{parent}.budget"
    join = f"JOIN {parent} USING ({', '.join(on)})" if parent else ""
    return f"""
{name}_in AS (SELECT {keys}, any_value({weight})::HUGEINT AS weight, sum(supply * 3)::HUGEINT AS capacity
              FROM leaves GROUP BY {keys}),
{name}_a AS (SELECT c.*, CAST({total} AS HUGEINT) AS total,
    coalesce(sum(c.capacity) OVER ({part} ORDER BY c.capacity::DOUBLE / c.weight::DOUBLE, {child}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
    sum(c.weight) OVER ({part} ORDER BY c.capacity::DOUBLE / c.weight::DOUBLE, {child}
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS weights FROM {name}_in AS c {join}),
{name}_b AS (SELECT *, capacity * weights <= weight * (total - before) AS filled FROM {name}_a),
{name}_c AS (SELECT *, coalesce(sum(capacity) FILTER (WHERE filled) OVER ({part}), 0)::HUGEINT AS taken,
    coalesce(sum(weight) FILTER (WHERE NOT filled) OVER ({part}), 0)::HUGEINT AS open FROM {name}_b),
{name} AS (SELECT {keys}, CASE WHEN filled THEN capacity ELSE weight * (total - taken) // open END AS budget
           FROM {name}_c)"""


@query("op10_mixing", r"""
WITH d AS (SELECT doc_id, lang, source,
    'domain' || (coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER), 0) % 3) AS domain,
    coalesce(lang, '') AS language, coalesce(source, '') AS origin,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens,
    md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
leaves AS (SELECT domain, language, origin, sum(n_tokens)::HUGEINT AS supply FROM d GROUP BY ALL HAVING supply > 0),"""
       + _fill_sql("dom", None, [], "domain", "CASE WHEN domain = 'domain0' THEN 2 ELSE 1 END") + ","
       + _fill_sql("lan", "dom", ["domain"], "language", "CASE WHEN language = 'en' THEN 4 ELSE 2 END") + ","
       + _fill_sql("src", "lan", ["domain", "language"], "origin", "1") + r""",
plan AS (SELECT *, budget // supply AS full_epochs, budget % supply AS rest
         FROM src JOIN leaves USING (domain, language, origin)),
ordered AS (SELECT d.*, full_epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, language, origin
    ORDER BY md5(CAST(full_epochs AS VARCHAR) || ':' || key) ROWS UNBOUNDED PRECEDING) <= rest AS more
    FROM d JOIN plan USING (domain, language, origin))
SELECT doc_id, lang, source, domain, n_tokens, CAST(unnest(range(full_epochs::BIGINT + more::BIGINT)) AS INTEGER) AS epoch
FROM ordered""")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _ = registered_mix(table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", "lang", "source", "domain", "n_tokens", "epoch")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit table over all documents: one row per encoded length."""
    return limit_table(histogram(token_lengths(table(spark, sf_dir, "documents"), read_encoder())))


def _kind_sql(number: int) -> str:
    kind, pattern, group, least = KINDS[number]
    pattern = pattern.replace("'", "''")
    return f"""
{kind}_a AS (SELECT rid, repo, owner, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS f,
             regexp_extract_all(t, '{pattern}', {group}) AS v FROM d WHERE regexp_matches(t, '{pattern}')),
{kind} AS (SELECT rid, repo, owner, {number} AS kind, e - length(f[i]) AS s, e, v[i] AS value
           FROM (SELECT *, CAST(sum(length(gaps[i]) + length(f[i])) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS e
                 FROM {kind}_a, LATERAL unnest(range(1, len(f) + 1)) AS t(i)) WHERE length(v[i]) >= {least})"""


_SPAN_SQL = "['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind"


@query("op2_secret_scan", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner,
           coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
{", ".join(_kind_sql(n) for n in range(len(KINDS)))},
c AS ({" UNION ALL ".join(f"SELECT * FROM {kind}" for kind, *_ in KINDS)}),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM c GROUP BY value),
j AS (SELECT rid, kind, s, e, CASE WHEN owners > {MAX_OWNERS} OR (owners > 1 AND repos > {MAX_REPOS}) THEN 'example'
             WHEN length(value) >= {LIVE_LENGTH} AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
                  AND NOT regexp_matches(value, '{PLACEHOLDER}')
                  AND len(list_distinct(string_split(value, ''))) >= {LIVE_DISTINCT} THEN 'live' ELSE 'other' END AS verdict
      FROM c JOIN o USING (value)),
k AS (SELECT * FROM j WHERE kind < {BASE_KINDS} OR (verdict = 'live' AND NOT EXISTS (
        SELECT 1 FROM j AS b WHERE b.rid = j.rid AND b.kind < {BASE_KINDS} AND b.s < j.e AND j.s < b.e))),
r AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
             count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE verdict = 'live') AS n_live,
             count(*) FILTER (WHERE verdict = 'example') AS n_example,
             string_agg({_SPAN_SQL}) FILTER (WHERE kind < {BASE_KINDS}) AS base, string_agg({_SPAN_SQL}) AS spans
      FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN r USING (rid)""")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is the owner; the source's part in one language is the repository."""
    repo = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    found = secret_scan(table(spark, sf_dir, "documents"), repo, F.col("source"))

    def count(field: str, value: object) -> Column:
        return F.size(F.filter("found", lambda s: s[field] == value)).cast("long")

    base = F.filter("found", lambda s: s["kind"] < BASE_KINDS)
    return found.select(
        "doc_id", *(count("kind", k).alias(f"n_{KINDS[k][0]}") for k in range(BASE_KINDS)),
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "example").alias("n_example"))


@query("op5_url_filter")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by their rule, else by the quality label of the same number."""
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"))
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part")
    return out.select("vec_id", "n", "deviation", "identity_error", parts).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"), "identity_error")


@query("op12_embedding_dedup", f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT *, len(e) AS d, sqrt(list_dot_product(e, e)) AS size FROM v WHERE label IS NOT NULL AND len(e) > 0
       AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM ok AS a JOIN ok AS b USING (label, d)
    WHERE a.rid <> b.rid AND list_dot_product(a.e, b.e) / (a.size * b.size) >= {MIN_COSINE}),
reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS rid, min(o.vec_id) AS component_id FROM reach JOIN v AS o ON o.rid = reach.b GROUP BY reach.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (rid) LEFT JOIN (SELECT a AS rid, count(*) AS n FROM links GROUP BY a) USING (rid)""")
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations")).conversations
