import random

import numpy as np
from helpers import docs
from pyspark.sql import functions as F

from leadlens.llm import toxicity as T


def corpus(n=240, seed=2):
    """Documents of syllable words; label 1 has a few words with a rude stem."""
    r = random.Random(seed)
    syllables = ["ba", "to", "ri", "en", "lo", "mi", "an", "us"]

    def word():
        return "".join(r.choice(syllables) for _ in range(r.randrange(2, 5)))

    rows = []
    for i in range(n):
        ws = [word() for _ in range(r.randrange(5, 120))]
        y = int(r.random() < 0.4)
        for _ in range(1 + len(ws) // 30 if y else 0):
            ws[r.randrange(len(ws))] = "zxq" + r.choice(syllables)
        rows.append((i, " ".join(ws), y))
    return rows


def test_gradients_equal_finite_differences(monkeypatch):
    monkeypatch.setattr(T, "WINDOW", 5)
    r = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in T.new_model(1).items()}
    x = r.normal(size=(12, 2 * T.EMBED))
    index = np.array([[0, 1, 2, 3, 4], [4, 5, 6, -1, -1], [7, 8, 7, 8, 11]])
    aim = r.normal(size=3)

    def loss():
        return float(T.forward(model, T._input_gates(model, x), index) @ aim)

    made = T.forward(model, T._input_gates(model, x), index, keep=True)
    g, gates = T.backward(model, made, aim, len(x))
    for side, d in zip("fb", gates, strict=True):
        g["x" + side], g["b" + side] = x.T @ d, d.sum(0)
    for name, grad in g.items():
        for at in list(np.ndindex(model[name].shape))[:40:7]:
            before = model[name][at]
            model[name][at] = before + 1e-4
            up = loss()
            model[name][at] = before - 1e-4
            down = loss()
            model[name][at] = before
            assert abs((up - down) / 2e-4 - grad[at]) < 2e-3, (name, at)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        starts = T.window_starts(n)
        seen = {i for s in starts for i in range(s, min(s + T.WINDOW, n))}
        assert seen == set(range(n)) and len(starts) >= 1


def test_blocks_do_not_change_scores(monkeypatch):
    rows = corpus(60)
    model = T.fit([(y, t) for _, t, y in rows], 0.4)
    texts = [None, "", "?!", " ".join(t for _, t, _ in rows)] + [t for _, t, _ in rows[:20]]
    whole = T.score_texts(model, texts)
    assert ((whole >= 0) & (whole <= 1)).all() and whole[0] == whole[1] == whole[2] == 0
    monkeypatch.setattr(T, "BLOCK", 48)
    assert np.allclose(T.score_texts(model, texts), whole, atol=1e-5)


def test_learns_held_out_labels_and_filters(spark):
    rows = corpus(400)
    table = docs(spark, *[(i, t) for i, t, _ in rows], (9000, None), (9001, ""), (9002, "w " * 50_000), (9003, rows[0][1]),
                 (9003, rows[0][1]), (None, "ba to"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9001, 1, None), (None, 1, 1), (77777, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    out = T.toxicity(table.withColumn("score", F.lit("x")), labels).collect()
    assert len(out) == table.count() and all(0 <= r.score <= 1 for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) for r in out)
    odd = table.withColumn("score", F.lit("x"))
    kept = T.without_toxic(odd, labels)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
        (r.doc_id for r in out if not r.predicted), key=repr)


def test_nothing_to_learn_from(spark):
    table = docs(spark, (1, "a b"), (2, None))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in T.toxicity(table, none).collect()] == [0.0, 0.0]
    clean = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in T.toxicity(table, clean).collect()] == [0, 0]
    assert T.toxicity(docs(spark), none).count() == 0


def test_training_bags_are_held_in_narrow_types():
    """The driver holds the tokens of the whole sample: a few bytes a character, not eight for each trigram."""
    text = " ".join(f"word{i}" for i in range(1000))
    bag = T._bag(text)
    assert sum(a.nbytes for a in bag[:3]) < 4 * len(text)
    wide = T.tokens(text)
    assert all((a == b).all() for a, b in zip(bag[:3], wide))
