import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leadlens.llm import queries as Q
from leadlens.llm import url_templates as U

PAGES = "page_id long, url string, html string"
LABELS = "doc_id long, quality int, toxic int"


def run(spark, pages, labels=(), **kw):
    table = spark.createDataFrame(pages, PAGES)
    return U.judge_urls(table, spark.createDataFrame(list(labels), LABELS), U.RULES, **kw)


def brute_rule(host, path):
    best = None
    for what, text in U.RULES:
        h, p = text[:text.index("/")], text[text.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(text) > len(best[1])):
            best = (what, text)
    return best


def brute_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


URLS = ["http://Example.ORG/es/1", "https://m.example.org/en/1", "https://m.example.org/en/12?x=/es/", "https://a.example.org/en/2",
        "http://example.org", "http://example.org?q=/es/", "http://notexample.org/es/1", "http://x.com/fr/9", "http://x.com/de/9#top",
        "http://com/de/", "http://x.com/en/4", "ftp://x.net/a/b", "no scheme", "", None, "://", "://É.com/de/", "http://x.com//de/",
        "http://a.com/de", "x://y://z.org/p", "http://org/\nq", "http://x.net/" + "s/" * 5000, "http://x.net/*/{n}/1"]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)]
    got = {r.page_id: r for r in run(spark, rows).collect()}
    assert len(got) == len(rows)
    for i, url in enumerate(URLS):
        host, path = brute_parse(url)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[1] if rule else None), url
        if rule:
            assert got[i].verdict == rule[0]
        assert got[i].verdict in ("allow", "block")


def test_bad_branch_is_rejected_and_good_ones_merge(spark):
    pages, labels = [], []
    for i in range(300):
        branch = ["news", "blog", "spam"][i % 3]
        pages.append((i, f"http://h.net/{branch}/post-{i}.html", ""))
        if i % 2:
            labels.append((i, int(branch != "spam"), 0))
    for i in range(300, 340):
        pages.append((i, f"http://other.net/p/{i}", None))
    got = {r.page_id: r for r in run(spark, pages, labels).collect()}
    assert {r.verdict for i, r in got.items() if i % 3 == 2 and i < 300} == {"block"}
    assert {r.verdict for i, r in got.items() if i % 3 != 2 or i >= 300} == {"allow"}
    by = defaultdict(set)
    for i, r in got.items():
        if i < 300:
            by[i % 3].add(r.template)
    assert by[2] == {"/spam/post-{n}.html"}
    for i, r in got.items():  # smoothed purity, from the counts
        if i % 3 == 2 and i < 300:
            host = (100 + 10 * 100 / 150) / (150 + 10)
            assert abs(r.purity - (0 + 10 * host) / (50 + 10)) < 1e-9


def test_variable_segments_become_wildcards(spark):
    names = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    pages = [(i, f"http://u.net/user/{n}/home", None) for i, n in enumerate(names)]
    pages += [(100 + i, "http://u.net/user/admin/home", None) for i in range(60)]
    labels = [(100 + i, i % 2, 0) for i in range(60)] + [(i, 1, 0) for i in range(10)]
    got = {r.page_id: r.template for r in run(spark, pages, labels).collect()}
    assert len({got[i] for i in range(10)}) == 1 and got[0].endswith("/*/home")
    assert got[100].endswith("/admin/home")


def test_bad_branch_of_a_wide_node_is_rejected(spark):
    sections = ["news", "blog", "shop", "help", "docs", "team", "jobs", "press", "spam", "forum"]
    pages = [(i, f"http://wide.net/{sections[i % 10]}/post-{i}.html", None) for i in range(600)]
    labels = [(i, int(i % 10 != 8), 0) for i in range(600) if i // 10 % 2]
    got = {r.page_id: r for r in run(spark, pages, labels).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {i for i in range(600) if i % 10 == 8}
    assert {got[i].template for i in range(8, 600, 10)} == {"/spam/post-{n}.html"}
    assert {r.template for i, r in got.items() if i % 10 != 8} == {"/*/post-{n}.html"}


@pytest.mark.parametrize("percent", [5, 15, 85])
def test_variable_slugs_share_one_template(spark, percent):
    """One labelled page a slug is no evidence: no page stands alone under its name, and the purity is the true share."""
    slug = [f"s{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(1000)]
    pages = [(i, f"http://slug.net/post/{slug[i]}", None) for i in range(1000)]
    labels = [(i, int(i * 37 % 100 >= percent), 0) for i in range(1000)]
    got = run(spark, pages, labels).collect()
    assert {r.template for r in got} == {"/post/*"}
    assert all(abs(r.purity - (1 - percent / 100)) < 1e-9 for r in got)
    assert {r.verdict for r in got} == {"block" if percent == 85 else "allow"}


def test_many_labels_still_merge_branches_that_are_alike(spark):
    """With thousands of labels every good section differs from a rest that holds the bad ones; alike, they merge."""
    sections = ["news", "blog", "shop", "help", "docs", "team", "jobs", "press", "spam", "forum"]
    pages = [(i, f"http://wide.net/{sections[i % 10]}/post-{i}.html", None) for i in range(4000)]
    labels = [(i, int(i % 10 != 8), 0) for i in range(4000)]
    got = {r.page_id: r for r in run(spark, pages, labels).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {i for i in range(4000) if i % 10 == 8}
    assert len({r.template for r in got.values()}) == 2


def test_deep_paths_generalise_per_segment(spark):
    slugs = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    deep = "/".join("abcdefghijkl")
    pages = [(i, f"http://deep.net/{deep}/{s}/end", None) for i, s in enumerate(slugs)]
    pages += [(100, "http://trap.net/" + "s/" * 3000, None)]
    got = {r.page_id: r.template for r in run(spark, pages).collect()}
    assert {got[i] for i in range(60)} == {f"/{deep}/*/end"}
    assert got[100] == "/" + "s/" * 3000


def brute_side(own, rest, tests):
    """own, rest: (good, bad). A likelihood ratio test as sums of logarithms of binomial likelihoods."""
    def loglik(good, bad, p):
        return (good and good * math.log(p)) + (bad and bad * math.log(1 - p))

    if min(sum(own), sum(rest)) < 10:
        return 0
    shares = [g / (g + b) for g, b in (own, rest)]
    both = (own[0] + rest[0]) / (sum(own) + sum(rest))
    ratio = 2 * sum(loglik(*c, p) - loglik(*c, both) for c, p in zip((own, rest), shares, strict=True))
    if ratio <= 3.841 + 2 * math.log(tests):
        return 0
    return 1 if shares[0] > shares[1] else -1


def brute_tree(rows):
    """rows: {(host, tokens): [good, bad, n]}. The template of each, node by node in plain Python."""
    out = {}

    def work(prefix, members):
        if len({tail for _, tail in members}) == 1 or not members:
            for key, tail in members:
                out[key] = prefix + "".join("/" + t for t in tail)
            return
        going = [(key, tail) for key, tail in members if tail]
        out.update({key: prefix for key, tail in members if not tail})
        child = defaultdict(lambda: [0, 0, 0])
        for key, tail in going:
            child[tail[0]] = [a + b for a, b in zip(child[tail[0]], rows[key], strict=True)]
        total = [sum(c[k] for c in child.values()) for k in range(3)]

        def rest(own, all_):
            return tuple(a - o for a, o in zip(all_[:2], own[:2], strict=True))

        sides = {t: brute_side(c[:2], rest(c, total), len(child)) for t, c in child.items()}
        free = {t for t, c in child.items() if t or (len(child) >= 8 and c[2] * len(child) < 2 * total[2])}
        names = {}
        for t, c in child.items():
            own_side = [child[o] for o in free if sides[o] == sides[t]]
            names[t] = t
            if t in free and len(own_side) > 1:
                pool = [sum(o[k] for o in own_side) for k in range(2)]
                if sides[t] == 0 or brute_side(c[:2], rest(c, pool), len(own_side)) == 0:
                    names[t] = {0: "*", 1: "*+", -1: "*-"}[sides[t]]
        nodes = defaultdict(list)
        for key, tail in going:
            nodes[names[tail[0]]].append((key, tail[1:]))
        for name, inner in nodes.items():
            work(f"{prefix}/{name}", inner)

    hosts = defaultdict(list)
    for host, tokens in rows:
        hosts[host].append(((host, tokens), tokens))
    for members in hosts.values():
        # The table works on a whole level before the next; nodes are independent, so the order does not matter.
        work("", members)
    return out


def test_tree_equals_brute_force(spark):
    r = random.Random(9)
    rows = {}
    for _ in range(700):
        tokens = tuple(r.choice(["a", "b", "c", "spam", "", "*", "x{n}", f"v{r.randrange(40)}"]) for _ in range(r.randrange(0, 5)))
        many = r.choice([0, 1, 1, 3, 40])
        bad = many if tokens[:1] == ("spam",) or "c" in tokens[1:2] else r.randrange(many + 1) if r.random() < 0.2 else 0
        rows[r.choice(["h", "h", "i"]), tokens] = [many - bad, bad, many + r.randrange(1, 5)]
    table = spark.createDataFrame([(h, list(t), *c) for (h, t), c in rows.items()],
                                  "host string, tokens array<string>, good long, bad long, n long").repartition(5)
    got = {(x.host, tuple(x.tokens)): x.template for x in U.generalise(table).collect()}
    assert got == brute_tree(rows)
    assert any("*-" in t for t in got.values()) or any("spam" in t for t in got.values())


def test_registered_query_equals_brute_force(spark):
    """The whole sf0.01 tables: parsing, rules, tree, purity and verdicts."""
    sf = "/root/testdata/sf0.01"
    known = {}
    for x in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect():
        known.setdefault(x.doc_id, []).append(x.quality)
    pages = [(x.page_id, *brute_parse(x.url)) for x in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    rows, keys, rules = defaultdict(lambda: [0, 0, 0]), {}, {}
    for page, host, path in pages:
        parts = path.removeprefix("/").split("/") if path else []
        tokens = tuple("{hex}" if re.fullmatch("[0-9A-Fa-f-]{8,}", s) and re.search("[0-9]", s) and re.search("[A-Fa-f]", s)
                       else re.sub("[0-9]+", "{n}", s) for s in parts)
        rules[page], keys[page] = brute_rule(host, path), (host, tokens)
        marks = [q for q in known.get(page, []) if q in (0, 1)]
        good = rules[page][0] == "allow" if rules[page] else min(marks) == 1 if marks else None
        count = rows[keys[page]]
        count[2] += 1
        if good is not None:
            count[not good] += 1
    template = brute_tree(rows)
    per, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for key, (good, bad, _) in rows.items():
        for c in (per[key[0], template[key]], hosts[key[0]]):
            c[0] += good
            c[1] += bad
    share = sum(g for g, _ in hosts.values()) / sum(map(sum, hosts.values()))
    got = {x.page_id: x for x in Q.QUERIES["op5_url_filter"](spark, sf).collect()}
    assert len(got) == len(pages)
    for page, host, path in pages:
        g, b = hosts[host]
        smooth = (g + 10 * share) / (g + b + 10)
        good, bad = per[host, template[keys[page]]]
        pure = (good + 10 * smooth) / (good + bad + 10)
        rule = rules[page]
        x = got[page]
        assert (x.host, x.path, x.rule, x.template) == (host, path, rule and rule[1], template[keys[page]])
        assert abs(x.purity - pure) < 1e-9
        assert x.verdict == (rule[0] if rule else "block" if pure < 0.5 else "allow")


def test_shapes(spark):
    paths = ["", "/", "/a/12/x9.html", "/file/0a1b2c3d4e5f/", "/deadbeef", "/12345678", "/1/2/3/4/5/6/7/8/9/x1"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(U.shapes(F.col("path")).alias("s")).collect()
    assert [r.s for r in rows] == [[], [""], ["a", "{n}", "x{n}.html"], ["file", "{hex}", ""], ["deadbeef"], ["{n}"],
                                   ["{n}"] * 9 + ["x{n}"]]


def test_label_rules_and_edges(spark):
    rows = [(1, "http://z.net/a/1", None), (1, "http://z.net/a/1", None), (None, "http://z.net/a/2", None), (2, None, None)]
    got = run(spark, rows, [(1, 0, 0), (1, 1, 0), (None, 0, 0), (2, None, 0)])
    assert got.count() == 4 and {r.verdict for r in got.collect()} == {"block"}  # one labelled page, bad in one label
    assert run(spark, []).count() == 0
    odd = spark.createDataFrame([(1, "http://z.net/a", "x", 5, 6)], PAGES + ", host int, template int")
    out = U.judge_urls(odd, spark.createDataFrame([], LABELS), U.RULES)
    assert [r.host for r in out.collect()] == ["z.net"]
