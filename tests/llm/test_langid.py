import random

import numpy as np
from helpers import docs

from leadlens.llm import langid as L

STEMS = {"aa": ["bro", "ska", "tun"], "bb": ["liu", "mei", "éa"], "cc": ["qor", "xaz", "wy"]}


def corpus(n=360, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(STEMS)[i % 3]
        text = " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(4, 60)))
        rows.append((i, text, lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "bb"), (903, "bro " * 60_000, None), (904, rows[0][1], None),
             (904, rows[0][1], None), (None, rows[1][1], "cc"), (905, "é", None)]
    table = docs(spark, *[(i, t, lang, "s", 1) for i, t, lang in rows + extra]).selectExpr("*", "1 as score", "2 as lang_pred")
    out = L.identify(table).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in out}
    for i in (900, 901, 902):
        assert (by[i].lang_pred, by[i].score, by[i].accepted) == ("und", 0.0, False)
    assert by[903].lang_pred == "aa" and by[904].lang_pred == truth[0] and by[905].lang_pred in truth.values()
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn_from(spark):
    out = L.identify(docs(spark, (1, "abc", None, None, 1), (2, None, None, None, 1))).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)] * 2
    assert L.identify(docs(spark)).count() == 0


def test_blocks_cover_the_text(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 10)
    raw = b"some words of a text withaverylongwordinside and more"
    parts = list(L.blocks(raw))
    assert b"".join(parts) == raw and len(parts) > 2
    assert sorted(np.concatenate([L.grams(p) for p in parts])) == sorted(L.grams(raw))


def test_rejection_threshold_reaches_its_precision():
    model = L.fit([(lang, t) for _, t, lang in corpus(200)])
    noise = [(lang, "bro liu qor") for lang in sorted(STEMS)] * 3
    held = [(model["langs"].index(lang), L.grams(L._lowered(t))) for lang, t in noise + [(x, t) for _, t, x in corpus(90, 8)]]
    heat, reject = L._calibrate(model, held)
    logits = np.stack([model["scores"][g].mean(0) for _, g in held]) + model["bias"]
    p = L._softmax(logits / heat)
    kept = p.max(1) >= reject
    assert (p.argmax(1) == np.array([y for y, _ in held]))[kept].mean() >= L.PRECISION - 0.02
