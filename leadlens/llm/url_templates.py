"""URL filter by a tree of path templates per host.

Explicit rules decide first: the longest rule whose host is the url's host or a parent domain of it and whose path
starts the url's path. All other urls get the verdict of their template.

Tree: a path's segments are the levels. Digit runs and hex strings become wildcards by their shape. Sibling branches
whose labelled shares do not differ are merged into one branch, '*'. A branch differs when a likelihood ratio test of its
labelled pages against those of its siblings says so; the critical value grows with the number of siblings (each is
tested), and a branch or a rest with under MIN_LABELLED labelled pages has too little evidence to differ, so single pages
of a variable segment always merge, whatever their labels. Branches that differ are gathered on either side, better and
worse than their siblings, and tested once more against the others of their side: those alike merge into '*+' or '*-',
those that differ again keep their names. So a node has few branches beside the ones that labels prove to be of their own.
An empty segment merges only at a node with many children where it occurs less often than twice the mean child. A
template's purity is the share of good pages among its labelled ones, smoothed towards its host's, itself smoothed towards
the whole table's; templates below ``min_purity`` are blocked. A page is labelled by its rule, else by ``labels``.

The tree is a table of (host, path shape) counts, worked on level by level with joins and aggregates; no host is
gathered anywhere, and a host with a third of the pages is mostly reduced before the first shuffle. Each level works on
the unfinished paths only, and paths of a node with one shape of remaining segments take the rest as it is, so there are
as many levels as the deepest node with two different ways on.

Edge cases: null urls and urls without '://' have empty host and path and share one template; null ids have no label
but a verdict; labels that disagree count as good only if all are; repeated rows count and are judged each; a segment
that is literally '*', '*+' or '*-' joins the merged branch of that name; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Rules of the registered query (verdict, host and path). Fixed values.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]
MANY_CHILDREN = 8
#: Labelled pages that a branch and the rest need each, and chi-square with one degree of freedom at 5 %. Its tail falls
#: about as exp(-x / 2), so adding 2 ln(m) to the critical value keeps the level over m tests.
MIN_LABELLED = 10
DIFFERENT = 3.841
SMOOTHING = 10.0
MIN_PURITY = 0.5


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one; of equally long ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])) if rules else []:
        at = text.index("/")
        fits = ((host == text[:at]) | F.endswith(host, F.lit("." + text[:at]))) & F.startswith(path, F.lit(text[at:]))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shapes(path: Column) -> Column:
    """Segments with digit runs and hex strings as wildcards."""
    def shape(s: Column) -> Column:
        is_hex = s.rlike("^[0-9A-Fa-f-]{8,}$") & s.rlike("[0-9]") & s.rlike("[A-Fa-f]")
        return F.when(is_hex, F.lit("{hex}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))

    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(parts, shape))


def side(good: Column, bad: Column, good_all: Column, bad_all: Column, tests: Column) -> Column:
    """1, -1 or 0: the branch's labelled share is better than, worse than or like the rest's (all less the branch)."""
    good, bad, good_all, bad_all = (c.cast("double") for c in (good, bad, good_all, bad_all))
    good_rest, bad_rest = good_all - good, bad_all - bad
    own, rest = good + bad, good_rest + bad_rest

    def part(seen: Column, n: Column, total: Column) -> Column:  # seen ln(seen / expected), 0 for none
        return F.when(seen > 0, seen * F.log(seen * (own + rest) / (n * total))).otherwise(0.0)

    ratio = 2 * (part(good, own, good_all) + part(bad, own, bad_all) + part(good_rest, rest, good_all)
                 + part(bad_rest, rest, bad_all))
    differs = (own >= MIN_LABELLED) & (rest >= MIN_LABELLED) & (ratio > DIFFERENT + 2 * F.log(tests.cast("double")))
    return F.when(F.coalesce(differs, F.lit(False)), F.when(good * rest > good_rest * own, 1).otherwise(-1)).otherwise(0)


def branch_names(child: DataFrame) -> DataFrame:
    """child: (host, template, token, n, good, bad). (host_, template_, token_, name) of every branch."""
    counts = ("n", "good", "bad")
    node = child.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("children"), *(F.sum(c).alias(c + "_all") for c in counts))
    rare = (F.col("children") >= MANY_CHILDREN) & (F.col("n") * F.col("children") < 2 * F.col("n_all"))
    first = child.join(node, ["host", "template"]).withColumn("rare", rare).withColumn(
        "side", side(F.col("good"), F.col("bad"), F.col("good_all"), F.col("bad_all"), F.col("children"))).drop(
        "children", "good_all", "bad_all", "n_all")
    # Empty segments that are not rare keep their name and are no member of a merged branch.
    first = written(first.withColumn("free", (F.col("token") != "") | F.col("rare")), "url-branches")
    sides = first.where("free").groupBy("host", "template", "side").agg(
        F.count(F.lit(1)).alias("members"), *(F.sum(c).alias(c + "_all") for c in ("good", "bad")))
    again = side(F.col("good"), F.col("bad"), F.col("good_all"), F.col("bad_all"), F.col("members"))
    merged = F.col("free") & (F.col("members") > 1) & ((F.col("side") == 0) | (again == 0))
    name = F.when(F.col("side") == 0, "*").when(F.col("side") == 1, "*+").otherwise("*-")
    return first.join(sides, ["host", "template", "side"], "left").select(
        F.col("host").alias("host_"), F.col("template").alias("template_"), F.col("token").alias("token_"),
        F.when(F.coalesce(merged, F.lit(False)), name).otherwise(F.col("token")).alias("name"))


def generalise(shaped: DataFrame) -> DataFrame:
    """shaped: (host, tokens, good, bad, n), unique by host and tokens. Adds ``template``."""
    now = shaped.withColumn("left", F.col("tokens")).withColumn("template", F.lit(""))
    done = None
    while True:
        # A node whose paths all go on alike has nothing to generalise: they take the rest as it is.
        ways = now.groupBy("host", "template").agg((F.min("left") == F.max("left")).alias("one_way"))
        now = written(now.join(ways, ["host", "template"]).withColumn(
            "whole", F.col("one_way") | (F.size("left") == 0)).drop("one_way"), "url-level")
        rest = F.when(F.size("left") > 0, F.concat(F.lit("/"), F.array_join("left", "/"))).otherwise("")
        ended = now.where("whole").select("host", "tokens", "n", "good", "bad", F.concat("template", rest).alias("template"))
        done = ended if done is None else done.unionByName(ended)
        now = now.where(~F.col("whole")).drop("whole").withColumn("token", F.element_at("left", 1))
        if now.isEmpty():
            return done
        names = branch_names(now.groupBy("host", "template", "token").agg(
            *(F.sum(c).alias(c) for c in ("n", "good", "bad"))))
        same = (F.col("host") == F.col("host_")) & (F.col("template") == F.col("template_")) & (
            F.col("token") == F.col("token_"))
        now = now.join(names, same).select(
            "host", "tokens", "n", "good", "bad", F.expr("slice(left, 2, greatest(size(left) - 1, 0))").alias("left"),
            F.concat("template", F.lit("/"), "name").alias("template"))


def purity(templates: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """templates: (host, template, good, bad). Adds purity, smoothed towards the host's and the table's share."""
    hosts = templates.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    total = hosts.agg(F.sum("g").alias("g"), F.sum("b").alias("b")).first()
    labelled = (total.g or 0) + (total.b or 0)
    share = (total.g or 0) / labelled if labelled else 1.0
    hosts = hosts.select(F.col("host").alias("host_"), ((F.col("g") + smoothing * share)
                         / (F.col("g") + F.col("b") + smoothing)).alias("host_purity"))
    return templates.join(hosts, F.col("host") == F.col("host_")).withColumn(
        "purity", (F.col("good") + smoothing * F.col("host_purity"))
        / (F.col("good") + F.col("bad") + smoothing)).drop("host_", "host_purity")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], url_col: str = "url",
               id_col: str = "page_id", label_id_col: str = "doc_id", label_col: str = "quality",
               min_purity: float = MIN_PURITY) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity (of the template)."""
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(label_id_col).isNotNull())
             .groupBy(F.col(label_id_col).alias("label_id")).agg(F.min(label_col).alias("label")))
    host, path = parse(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"),
                       shapes(F.col("path")).alias("tokens"))
    labelled = rows.join(known, F.col("page_id") == F.col("label_id"), "left")
    good = F.when(F.col("ruled").isNotNull(), F.col("ruled") == "allow").otherwise(F.col("label") == 1)
    shaped = written(labelled.withColumn("is_good", good).groupBy("host", "tokens").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_good").alias("good"), F.count_if(~F.col("is_good")).alias("bad")),
        "url-shapes")
    tree = generalise(shaped)
    templates = purity(tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    named = written(tree.select("host", "tokens", "template").join(
        templates.select("host", "template", "purity"), ["host", "template"]).select(
            F.col("host").alias("host_"), F.col("tokens").alias("tokens_"), "template", "purity"), "url-templates")
    found = rows.join(named, (F.col("host") == F.col("host_")) & (F.col("tokens") == F.col("tokens_")))
    own = F.when(F.col("purity") < min_purity, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")
