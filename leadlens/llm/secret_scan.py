"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are three base kinds (an assignment to a secret-like name, an access key id, a run of hex digits) and one
that the method adds: long opaque strings of letters and digits. Each candidate's value is hashed, and the hashes are
aggregated over the corpus by distinct repositories and distinct owners. Owners decide: a value held by more than
``max_owners`` owners is a widely copied example, and one that a single owner holds is owner-specific however many of
that owner's repositories it is in. Repositories refine what lies between: a value of several owners, though not too
many, is an example too when it is spread over more than ``max_repos`` repositories. A value that is no example and looks
live (letters and digits, many distinct characters, no placeholder word) is a credential. Base spans always stay; an
opaque string becomes a span only if it is such a credential and touches no base span of its text.

Positions: splitting a text at a pattern and extracting the pattern's matches give the pieces in turn, so running sums
of their lengths are the offsets, in code points. Values are kept as SHA-256 only.

A value copied into a third of all documents is counted by two partial aggregations (distinct owner and repository
first) and meets its candidates in a join that AQE splits.

Edge cases: null texts are empty; null repositories or owners count as one named ''; rows that repeat are scanned and
counted each, which changes no distinct count; a table without candidates gives zero counts; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, written


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Kinds in the order of ties, with pattern, group of the value, least length of the value. Fixed values.
ASSIGN = ("(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
          + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Runs are maximal, so a least length inside the pattern drops the same matches as dropping shorter ones later.
KINDS = [("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]{14,}", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16),
         ("opaque", "[A-Za-z0-9+/_-]{20,}", 0, 20)]
BASE_KINDS = 3
PLACEHOLDER = "|".join(either_case(w) for w in ("example", "sample", "dummy", "placeholder", "changeme", "password",
                                                "your", "xxxx", "test", "12345"))
LIVE_LENGTH, LIVE_DISTINCT = 16, 8
MAX_OWNERS, MAX_REPOS = 2, 4


def looks_live(value: Column) -> Column:
    letters = value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)
    return (F.length(value) >= LIVE_LENGTH) & letters & (
        F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT)


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """Null without a match, else in turn: (length before the match, its length, value length, hash, live)."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def piece(x: Column) -> Column:
        return F.struct(x["gap"].alias("gap"), F.length(x["found"]).alias("size"),
                        F.length(x["value"]).alias("value_size"), F.sha2(x["value"], 256).alias("hash"),
                        looks_live(x["value"]).alias("live"))

    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("found"), values.alias("value"))
    return F.when(text.rlike(pattern), F.transform(parts, piece))


def scan(docs: DataFrame, repo: Column, owner: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(rid, doc_id, repo, owner, one array of pieces per kind): the only pass over the texts. rid tells rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return checkpointed(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        *(_pieces(text, pattern, group).alias(kind) for kind, pattern, group, _ in KINDS)))


def candidates(scanned: DataFrame) -> DataFrame:
    """(rid, repo, owner, kind number, start, end, hash, live): matches that are long enough, with their offsets."""
    found = None
    for number, (kind, _, _, least) in enumerate(KINDS):
        upto = F.sum(F.col("p.gap") + F.col("p.size")).over(
            Window.partitionBy("rid").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
        rows = (scanned.where(F.col(kind).isNotNull()).select("rid", "repo", "owner", F.posexplode(kind).alias("n", "p"))
                .withColumn("end", upto.cast("long")).where(F.col("p.value_size") >= least)
                .select("rid", "repo", "owner", F.lit(number).alias("kind"),
                        (F.col("end") - F.col("p.size")).alias("start"), "end", "p.hash", "p.live"))
        found = rows if found is None else found.unionByName(rows)
    return found


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos): distinct owners and repositories that hold each value."""
    pairs = found.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    return pairs.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))


def secret_scan(docs: DataFrame, repo: Column, owner: Column, text_col: str = "text", id_col: str = "doc_id",
                max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per document: doc_id and ``found``, an array by start and kind of
    struct(start, kind, end, hash, verdict), kind being a number in KINDS and verdict live, example or other."""
    scanned = scan(docs, repo, owner, text_col, id_col)
    found = written(candidates(scanned), "candidates")
    held = written(ownership(found).withColumnRenamed("hash", "hash_"), "ownership")
    spread = (F.col("owners") > 1) & (F.col("repos") > max_repos)
    verdict = (F.when((F.col("owners") > max_owners) | spread, "example")
               .when(F.col("live"), "live").otherwise("other"))
    judged = found.join(held, F.col("hash") == F.col("hash_")).withColumn("verdict", verdict)
    # An opaque span may touch no base span: nothing that began before it may reach it, nothing may begin inside it.
    by_start = Window.partitionBy("rid").orderBy("start")
    base = F.col("kind") < BASE_KINDS
    judged = (judged
              .withColumn("reach", F.max(F.when(base, F.col("end"))).over(
                  by_start.rangeBetween(Window.unboundedPreceding, 0)))
              .withColumn("next", F.min(F.when(base, F.col("start"))).over(
                  by_start.rangeBetween(0, Window.unboundedFollowing))))
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    spans = judged.where(base | (free & (F.col("verdict") == "live"))).groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "hash", "verdict"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hash:string,verdict:string>>")
    return scanned.select("rid", "doc_id").join(spans, "rid", "left").select(
        "doc_id", F.coalesce("found", none).alias("found"))


def span_list(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(kind) for kind, *_ in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
