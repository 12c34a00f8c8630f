import random

from helpers import docs

from leadlens.llm import line_dedup as L


def brute(rows):
    """(doc_id, text after, lines removed) of (doc_id, text) rows; equal rows are one document."""
    first = {}
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            if "".join(lines[p:p + 3]).strip(" \t\r\x0b\x0c"):
                first.setdefault(tuple(lines[p:p + 3]), (i, t, p))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        lines = t.split("\n")
        gone = {q for p in range(len(lines) - 2) for q in range(p, p + 3)
                if first.get(tuple(lines[p:p + 3]), (i, t, p)) != (i, t, p)}
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice("abcd") for _ in range(r.randrange(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, " \n\t\n \nx\ny\nz"), (105, "x\ny\nz"),
             (106, "p\nq"), (107, "p\nq"), (108, "1\n2\n3\n1\n2\n3\n1\n2\n3"), (109, "same\nrow\nhere"),
             (109, "same\nrow\nhere"), (None, "n\nu\nl"), (110, "n\nu\nl"), (111, "l\r\nl\r\nl\r\n"),
             (112, "\n".join(["very", "long"] * 30_000))]
    got = L.dedup_lines(docs(spark, *rows).repartition(4)).collect()
    assert sorted(((x.doc_id, x.text, x.n_removed) for x in got), key=repr) == brute(rows)


def test_extra_columns_with_clashing_names(spark):
    odd = docs(spark, (1, "a\nb\nc"), (2, "z\na\nb\nc")).selectExpr("*", "7 as n_removed", "8 as starts", "9 as text_key",
                                                                    "10 as pos")
    out = L.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_removed_"]
    assert [(r.doc_id, r.text, r.n_removed, r.n_removed_) for r in out.orderBy("doc_id").collect()] == [
        (1, "a\nb\nc", 7, 0), (2, "z", 7, 3)]


def test_merged_cover():
    assert L.keep_lines("a\nb\nc\nd\ne\nf", [2, 1], 3) == ("a\nf", 4)
    assert L.keep_lines("a\nb\nc", [0], 3) == ("", 3)


def test_empty_table(spark):
    assert L.dedup_lines(docs(spark)).count() == 0


def test_blank_and_split_lines(spark):
    """Blank lines that differ make different windows; a line's end is no part of the next one's start."""
    rows = [(1, " \nx\n\t"), (2, "\t\nx\n "), (3, " \nx\n\t"), (4, "ab\nc\nd"), (5, "a\nbc\nd"), (6, "\x0b\n\x0c\n\r"),
            (7, "\x0b\n\x0c\n\r"), (8, "\xa0\n\n"), (9, "\xa0\n\n"), (10, " \n \n z \nq"), (11, " \n \n z ")]
    got = L.dedup_lines(docs(spark, *rows)).collect()
    assert sorted(((x.doc_id, x.text, x.n_removed) for x in got), key=repr) == brute(rows)
    assert {x.doc_id for x in got if x.n_removed} == {3, 9, 11}


def test_windows_do_not_copy_their_lines(spark):
    """Lines are hashed and judged blank once, so windows are made of hashes and no text is copied for each window."""
    plan = L.windows(docs(spark, (1, "a\nb\nc")))._jdf.queryExecution().optimizedPlan().toString()
    made, = [x for x in plan.split("+- ") if x.startswith("Generate")]
    assert "translate(" not in plan and "slice(" in made
    assert all(".sha" in x or ".solid" in x for x in made.split("slice(")[1:])
