"""Bounded training samples, and held-out accuracy of the trained operators on the given tables."""

import random

from helpers import docs
from pyspark.sql import functions as F

from leadlens.llm import queries as Q
from leadlens.llm import sampling as S

SF = "/root/testdata/sf0.1"
SCHEMA = "label string, doc_id string, text string"


def test_one_row_per_id_and_bounded_labels(spark):
    rows = [("a", "same", f"text {i % 3}") for i in range(20_000)] + [("b", f"id{i}", "b text") for i in range(50)]
    rows += [(f"rare{i}", f"r{i}", "rare") for i in range(9)] + [("a", None, "no id"), ("a", "empty", ""), ("a", "null", None)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = S.training_rows(table.where("doc_id is not null"), "label", per_label=10, max_chars=100, most_labels=2)
    assert sorted(label for label, _ in got) == ["a"] + ["b"] * 10
    assert {t for label, t in got if label == "a"} <= {"text 0", "text 1", "text 2"}
    assert got == S.training_rows(table.where("doc_id is not null").repartition(3), "label", 10, 100, most_labels=2)
    assert S.training_rows(spark.createDataFrame([], SCHEMA), "label", 10, 100) == []


def test_long_texts_enter_by_whole_windows(spark):
    text = "".join(f"{i:07d} " for i in range(5000))
    got = spark.createDataFrame([(text,), ("short",), ("x" * 800,)], "t string").select(
        S.bounded_text(F.col("t"), 800).alias("t")).collect()
    assert [r.t for r in got[1:]] == ["short", "x" * 800]
    pieces = [got[0].t[k * 101:k * 101 + 100] for k in range(S.WINDOWS)]
    at = [text.index(p) for p in pieces]
    assert len(got[0].t) == S.WINDOWS * 101 - 1 and at[0] == 0 and at[-1] == len(text) - 100
    assert max(b - a for a, b in zip(at, at[1:])) - min(b - a for a, b in zip(at, at[1:])) <= 1


def test_language_of_long_texts_only_is_learned(spark):
    r = random.Random(5)
    stems = {"aa": ["bro", "ska", "tun"], "bb": ["liu", "mei", "wy"]}

    def text(lang, n):
        return " ".join("".join(r.choice(stems[lang]) for _ in range(2)) for _ in range(n))

    rows = [(i, text("aa", 40), "aa", "s", 1) for i in range(60)] + [(100 + i, text("bb", 3000), "bb", "s", 1) for i in range(30)]
    rows += [(1000, text("bb", 30), None, "s", 1), (1001, text("aa", 30), None, "s", 1)]
    from leadlens.llm import langid
    got = {x.doc_id: x.lang_pred for x in langid.identify(docs(spark, *rows)).collect()}
    assert (got[1000], got[1001]) == ("bb", "aa")


def test_held_out_languages_of_the_given_table(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in Q.QUERIES["op6_language_id"](spark, SF).collect() if r.held_out and truth[r.doc_id] is not None]
    assert len(held) > 1000 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.99


def test_held_out_toxicity_of_the_given_tables(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    held = [r for r in Q.QUERIES["op4_toxicity"](spark, SF).collect() if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hit / sum(truth[r.doc_id] for r in held) >= 0.8 and hit / sum(r.predicted for r in held) >= 0.75
