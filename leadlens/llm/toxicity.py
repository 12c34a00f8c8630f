"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Each word enters as the embedding of its hash joined with the mean embedding of its hashed character trigrams (word
borders marked), so unseen words are judged by their letters. Two GRUs read every window of ``WINDOW`` words, one in
each direction; attention pools their states into one score a window. Windows overlap and cover the whole text, and
a document scores as its most toxic window, mapped to a probability by a calibration on rows kept out of training.

Labels mark documents, not windows: training sends each document's gradient to its windows in proportion to a softmax
of their scores, which starts near the mean and closes in on the worst window. The network, its gradients and the Adam
steps are numpy; training runs on the driver on a bounded, documented sample of labelled rows (``PER_LABEL`` rows of
each label, up to ``MAX_CHARS`` characters of each, longer texts by evenly spaced pieces; at most ``BAG`` evenly spaced
windows of each).

Scoring is a map over Arrow batches without a shuffle; texts are cut into blocks of bounded size, so memory does not
grow with the length of a text.

Edge cases: null, empty and word-less texts have no window and score 0; documents without a label or with a null
label are not learned from; if no label of one kind exists, texts with words score that share of labels (0 without any);
repeated rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import LOWER_BYTES, map_batches, own_columns, with_field
from .sampling import crc_bucket, training_rows

WINDOW, STRIDE = 32, 24
WORD_ROWS, CHAR_ROWS, EMBED = 1 << 15, 1 << 14, 8
HIDDEN, ATTEND = 8, 8
PER_LABEL, MAX_CHARS, BAG = 2500, 8000, 24
#: Small samples get smaller batches and more passes, so that they too see enough steps.
EPOCHS, BATCH, RATE, SEED = 10, 64, 0.01, 7
THRESHOLD = 0.3
#: Words scored at a time.
BLOCK = 1 << 15

_LETTER = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULT
    return x ^ (x >> np.uint64(29))


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows, trigram rows of all words one after another, first trigram of each word)."""
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES) + b" ", np.uint8)
    letter = _LETTER[raw]
    turns = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = turns[::2] + 1, turns[1::2] + 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    own = np.where(letter, raw, 0).astype(np.uint64)  # zero marks a word border
    grams = _mix(own[:-2] << np.uint64(16) | own[1:-1] << np.uint64(8) | own[2:])[letter[1:-1]]
    first = np.cumsum(ends - starts) - (ends - starts)
    place = np.arange(len(grams)) - np.repeat(first, ends - starts)
    words = _mix(np.add.reduceat(_mix(grams + place.astype(np.uint64) * _MULT), first))
    return (words % np.uint64(WORD_ROWS)).astype(np.int64), (grams % np.uint64(CHAR_ROWS)).astype(np.int64), first


def window_starts(n: int) -> np.ndarray:
    """First words of the overlapping windows over n words."""
    return np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return r.normal(0, scale, shape).astype(np.float32)

    model = {"word": normal(WORD_ROWS, EMBED, scale=0.1), "char": normal(CHAR_ROWS, EMBED, scale=0.3),
             "att_w": normal(2 * HIDDEN, ATTEND, scale=0.3), "att_v": normal(ATTEND, scale=0.3),
             "out_w": normal(2 * HIDDEN, scale=0.3), "out_b": np.zeros(1, np.float32)}
    for side in "fb":
        model["x" + side] = normal(2 * EMBED, 3 * HIDDEN, scale=0.3)
        model["h" + side] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
        model["b" + side] = np.zeros(3 * HIDDEN, np.float32)
    return model


def embed(model: dict, words: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(first, len(grams)))
    chars = np.add.reduceat(model["char"][grams], first, axis=0) / sizes[:, None].astype(np.float32)
    return np.concatenate([model["word"][words], chars], axis=1)


def forward(model: dict, gates: tuple[np.ndarray, np.ndarray], index: np.ndarray, keep: bool = False):
    """Scores (logits) of windows. gates: input parts of both GRUs per word; index: (windows, WINDOW) words, -1 none."""
    there = (index >= 0).T  # time first
    mask = there[:, :, None].astype(np.float32)
    n, H = index.shape[0], HIDDEN
    states = np.zeros((WINDOW, n, 2 * H), np.float32)
    trace = []
    at = np.where(index >= 0, index, 0).T
    for k, side in enumerate("fb"):
        h = np.zeros((n, H), np.float32)
        U = model["h" + side]
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x = gates[k][at[t]]
            u = h @ U
            zr = _sigmoid(x[:, :2 * H] + u[:, :2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(x[:, 2 * H:] + r * u[:, 2 * H:])
            new = (c + z * (h - c)) * mask[t]
            if keep:
                trace.append((side, t, h, z, r, c, u[:, 2 * H:]))
            h = new
            states[t, :, k * H:(k + 1) * H] = h
    inner = np.tanh(states.reshape(-1, 2 * H) @ model["att_w"]).reshape(WINDOW, n, ATTEND)
    score = np.where(there, inner @ model["att_v"], -30)
    weight = np.exp(score - score.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    logit = pooled @ model["out_w"] + model["out_b"][0]
    return (logit, states, inner, weight, pooled, trace, mask, at) if keep else logit


def backward(model: dict, made: tuple, d_logit: np.ndarray, n_words: int) -> tuple[dict, tuple]:
    """Gradients of the dense weights and of both GRUs' input parts per word."""
    _, states, inner, weight, pooled, trace, mask, at = made
    H, n = HIDDEN, len(d_logit)
    g = {"out_w": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
    d_pool = d_logit[:, None] * model["out_w"]
    d_weight = np.einsum("nh,tnh->tn", d_pool, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    g["att_v"] = np.einsum("tn,tna->a", d_score, inner)
    d_inner = d_score[:, :, None] * model["att_v"] * (1 - inner ** 2)
    g["att_w"] = states.reshape(-1, 2 * H).T @ d_inner.reshape(-1, ATTEND)
    d_states = weight[:, :, None] * d_pool + d_inner @ model["att_w"].T
    gates = []
    for k, side in enumerate("fb"):
        U, dU = model["h" + side], np.zeros_like(model["h" + side])
        d_gate = np.zeros((n_words, 3 * H), np.float32)
        d_h = np.zeros((n, H), np.float32)
        for s, t, h, z, r, c, uc in reversed(trace):
            if s != side:
                continue
            d_new = (d_states[t, :, k * H:(k + 1) * H] + d_h) * mask[t]
            d_c = d_new * (1 - z) * (1 - c ** 2)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * uc * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
            dU += h.T @ d_u
            d_h = d_new * z + d_u @ U.T
            _add_rows(d_gate, at[t], np.concatenate([d_z, d_r, d_c], axis=1) * mask[t])
        g["h" + side] = dU
        gates.append(d_gate)
    return g, tuple(gates)


def _add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """out[rows] += values, rows repeated or not."""
    order = np.argsort(rows, kind="stable")
    sorted_ = rows[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    out[sorted_[starts]] += np.add.reduceat(values[order], starts, axis=0)


def _bag(text: str) -> tuple | None:
    """Tokens and at most BAG evenly spaced windows of a training text, in types no wider than they need: the driver
    holds them for all rows of the sample."""
    words, grams, first = tokens(text)
    if not len(words):
        return None
    starts = window_starts(len(words))
    if len(starts) > BAG:
        starts = starts[np.linspace(0, len(starts) - 1, BAG).astype(int)]
    index = starts[:, None] + np.arange(WINDOW)
    return (words.astype(np.uint16), grams.astype(np.uint16), first.astype(np.int32),
            np.where(index < len(words), index, -1).astype(np.int32))


def _join(bags: list[tuple]) -> tuple:
    """One set of tokens and windows for several texts, and the bag of each window."""
    at = np.cumsum([0] + [len(b[0]) for b in bags])
    grams = np.cumsum([0] + [len(b[1]) for b in bags])
    return (np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]),
            np.concatenate([b[2] + g for b, g in zip(bags, grams[:-1], strict=True)]),
            np.concatenate([np.where(b[3] >= 0, b[3] + a, -1) for b, a in zip(bags, at[:-1], strict=True)]),
            np.repeat(np.arange(len(bags)), [len(b[3]) for b in bags]))


def _input_gates(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x @ model["xf"] + model["bf"], x @ model["xb"] + model["bb"]


def fit(rows: list[tuple[int, str]], share: float, seed: int = SEED) -> dict[str, np.ndarray]:
    """Train on (label, text) rows; ``share`` is label 1's share of all labelled rows, for the calibration."""
    bags = [(int(y), b) for y, text in rows if (b := _bag(text)) is not None]
    del rows  # the texts are not held while training
    model = new_model(seed)
    labels = {y for y, _ in bags}
    if labels != {0, 1}:
        return {"constant": np.float32(share)}
    r = np.random.default_rng(seed)
    order = r.permutation(len(bags))
    held = [bags[i] for i in order[:len(bags) // 6]]
    used = [bags[i] for i in order[len(bags) // 6:]]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step, batch = 0, min(BATCH, max(8, len(used) // 40))
    epochs = EPOCHS * max(1, min(3, 2000 // len(used)))
    for epoch in range(epochs):
        r.shuffle(used)
        rate = RATE * (1 - 0.9 * epoch / epochs)
        sharp = 1.0 + EPOCHS * epoch / epochs  # the softmax over a document's windows closes in on the worst
        for k in range(0, len(used), batch):
            part = used[k:k + batch]
            words, grams, first, index, bag = _join([b for _, b in part])
            y = np.array([y for y, _ in part], np.float32)
            x = embed(model, words, grams, first)
            made = forward(model, _input_gates(model, x), index, keep=True)
            logit = made[0]
            top = np.full(len(part), -np.inf)
            np.maximum.at(top, bag, logit)
            e = np.exp(np.clip(sharp * (logit - top[bag]), -60, 0))
            w = e / np.bincount(bag, e, len(part))[bag]
            pooled = np.bincount(bag, w * logit, len(part))
            d = ((_sigmoid(pooled) - y) / len(part))[bag] * w
            g, gates = backward(model, made, d.astype(np.float32), len(words))
            d_x = 0
            for side, d_gate in zip("fb", gates, strict=True):
                g["x" + side], g["b" + side] = x.T @ d_gate, d_gate.sum(0)
                d_x = d_x + d_gate @ model["x" + side].T
            g["word"], g["char"] = np.zeros_like(model["word"]), np.zeros_like(model["char"])
            _add_rows(g["word"], words, d_x[:, :EMBED])
            sizes = np.diff(np.append(first, len(grams)))
            _add_rows(g["char"], grams, np.repeat(d_x[:, EMBED:] / sizes[:, None].astype(np.float32), sizes, axis=0))
            step += 1
            for name, grad in g.items():
                m, v = moment[name]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad ** 2 - v)
                model[name] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-6)).astype(np.float32)
    model["calibration"] = _calibrate(model, held or used, share)
    return model


def _calibrate(model: dict, held: list, share: float) -> np.ndarray:
    """(slope, offset) of a logistic curve over the worst windows' scores, rows weighted to the labels' real shares."""
    y = np.array([y for y, _ in held], float)
    s = np.array([forward(model, _input_gates(model, embed(model, *b[:3])), b[3]).max() for _, b in held])
    if y.min() == y.max():
        return np.array([1.0, 0.0])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    a = np.array([1.0, 0.0])
    for _ in range(200):  # Newton steps with a small ridge
        p = _sigmoid(a[0] * s + a[1])
        X = np.stack([s, np.ones_like(s)], 1)
        grad = X.T @ (weight * (p - y)) + 1e-3 * (a - [1.0, 0.0])
        hess = (X * (weight * p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2)
        a = a - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return np.array([max(a[0], 0.05), a[1]])


def score_texts(model: dict, texts: list[str | None]) -> np.ndarray:
    """Scores in [0, 1]. Texts are gathered into blocks of about BLOCK words; longer ones go block by block."""
    if "constant" in model:
        return np.array([float(model["constant"]) if len(tokens(t)[0]) else 0.0 for t in texts])
    worst = np.full(len(texts), -np.inf)
    pending: list[tuple] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pending:
            words, grams, first, index, bag = _join(pending)
            gates = _input_gates(model, embed(model, words, grams, first))
            for at in range(0, len(index), 2048):
                logit = forward(model, gates, index[at:at + 2048])
                np.maximum.at(worst, np.array(owners)[bag[at:at + 2048]], logit)
        pending.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        words, grams, first = tokens(text)
        starts = window_starts(len(words)) if len(words) else words
        for k in range(0, len(starts), BLOCK // STRIDE):
            part = starts[k:k + BLOCK // STRIDE]
            a, b = part[0], min(part[-1] + WINDOW, len(words))
            g = slice(first[a], first[b] if b < len(words) else len(grams))
            index = part[:, None] - a + np.arange(WINDOW)
            pending.append((words[a:b], grams[g], first[a:b] - first[a], np.where(index < b - a, index, -1)))
            owners.append(i)
            size += b - a
            if size >= BLOCK:
                flush()
    flush()
    slope, offset = model["calibration"]
    return np.where(np.isinf(worst), 0.0, _sigmoid(slope * worst + offset))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          label_col: str = "toxic") -> dict[str, np.ndarray]:
    """Fit on labelled documents whose crc32(id) mod 4 is not 2."""
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(
        crc_bucket("doc_id", 4) != 2)
    known = known.withColumnRenamed("label_id", "doc_id")
    share = rows.select("doc_id").join(known, "doc_id").agg(F.avg("label")).first()[0] or 0.0
    return fit(training_rows(rows, "label", PER_LABEL, MAX_CHARS, known=known), share)


def _scores(docs: DataFrame, model: dict, keep: bool, text_col: str, threshold: float) -> DataFrame:
    """A double column ``score`` beside all others, or (keep) only the rows under the threshold, columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    score, = own_columns(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = score_texts(held.value, b.column(at).to_pylist())
            if keep:
                yield b.filter(pa.array(found < threshold))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*b.schema.names, score])

    return map_batches(docs, run, docs.schema if keep else with_field(docs.schema, score, DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, text_col, id_col, label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _scores(rows, model, False, "text", threshold).select(
        "doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, all columns. A map without a shuffle."""
    return _scores(docs, train(docs, labels, text_col, id_col, label_col), True, text_col, threshold)
