"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its hashed byte n-grams (3 and 4 bytes of each word, borders marked), as the
subword models of fastText do; a linear layer and a softmax follow. As everything up to the softmax is linear, the
trained embeddings are folded with the layer into one table of scores per n-gram, and a text costs one lookup a byte.

Training takes a bounded sample (``PER_LANG`` documents of each of at most MOST_LABELS languages; up to ``MAX_CHARS``
characters of each, longer texts by evenly spaced windows; of those up to ``MAX_GRAMS`` n-grams spread evenly, and two
short cuts). A part is kept back: on it a
temperature calibrates the scores, and the rejection threshold is the least score from which on at least
``PRECISION`` of the predictions are right.

Edge cases: null texts and texts without a letter are ``und`` with score 0; with nothing to learn from, all are;
null languages are not learned from; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, map_batches
from .sampling import crc_bucket, training_rows

ROWS, EMBED = 1 << 16, 16
PER_LANG, MAX_CHARS, MAX_GRAMS = 1500, 8000, 1200
EPOCHS, BATCH, RATE, SEED = 8, 64, 4.0, 11
PRECISION = 0.99
#: Bytes of text looked up at a time.
BLOCK = 1 << 20

_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_HAS_LETTER = regex.compile(r"\p{L}")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams(raw: bytes) -> np.ndarray:
    """Table rows of the n-grams of lower-cased text."""
    own = np.frombuffer(b"  " + raw + b"  ", np.uint8)
    letter = _LETTER[own]
    own = np.where(letter, own, 0).astype(np.uint64)  # zero marks a word border
    three = own[:-3] << np.uint64(16) | own[1:-2] << np.uint64(8) | own[2:-1]
    four = three << np.uint64(8) | own[3:]
    inside = letter[1:-2]
    rows = np.concatenate([three[inside], four[inside & letter[2:-1]] + np.uint64(1 << 40)]) * _MULT
    return (rows >> np.uint64(48)).astype(np.int64)


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES)


def blocks(raw: bytes) -> Iterator[bytes]:
    """Pieces of about BLOCK bytes, cut at spaces; a longer word stays whole."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def fit(rows: list[tuple[str, str]], seed: int = SEED) -> dict | None:
    """Train on (language, text) rows."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    r = np.random.default_rng(seed)
    samples: list[list[tuple[int, np.ndarray]]] = []  # by document, as its cuts go to the same side of the split
    for lang, text in rows:
        raw = _lowered(text)
        cuts = [raw] + [raw[(at := int(r.integers(0, max(1, len(raw) - 30)))):at + int(r.integers(30, 200))]
                        for _ in range(2)]
        kept = []
        for cut in cuts:
            g = grams(cut)
            if len(g) > MAX_GRAMS:
                g = g[np.linspace(0, len(g) - 1, MAX_GRAMS).astype(int)]
            if len(g):
                kept.append((langs.index(lang), g))
        samples.append(kept)
    order = r.permutation(len(samples))
    held = [s for i in order[:len(order) // 6] for s in samples[i]]
    used = [s for i in order[len(order) // 6:] for s in samples[i]]
    table = r.normal(0, 0.1, (ROWS, EMBED)).astype(np.float32)
    layer, bias = np.zeros((EMBED, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    epochs = EPOCHS * max(1, min(5, 6000 // max(1, len(used))))
    for epoch in range(epochs):
        r.shuffle(used)
        rate = RATE * (1 - epoch / epochs)
        for k in range(0, len(used), BATCH):
            part = used[k:k + BATCH]
            y, rows_ = np.array([p[0] for p in part]), np.concatenate([p[1] for p in part])
            sizes = np.array([len(p[1]) for p in part])
            first = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(table[rows_], first, axis=0) / sizes[:, None].astype(np.float32)
            p = _softmax(mean @ layer + bias)
            p[np.arange(len(part)), y] -= 1
            d = (p / len(part)).astype(np.float32)
            d_mean = (d @ layer.T) / sizes[:, None].astype(np.float32)
            layer -= rate * (mean.T @ d)
            bias -= rate * 0.1 * d.sum(0)
            np.subtract.at(table, rows_, rate * BATCH * np.repeat(d_mean, sizes, axis=0))
    model = {"langs": langs, "scores": (table @ layer).astype(np.float32), "bias": bias, "heat": 1.0, "reject": 0.0}
    model["heat"], model["reject"] = _calibrate(model, held or used)
    return model


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _calibrate(model: dict, held: list[tuple[int, np.ndarray]]) -> tuple[float, float]:
    """Temperature with the least log loss, and the least score from which on PRECISION is reached."""
    y = np.array([s[0] for s in held])
    logits = np.stack([model["scores"][g].mean(0) for _, g in held]) + model["bias"]
    heats = np.geomspace(0.1, 10, 41)
    loss = [-np.log(np.maximum(_softmax(logits / h)[np.arange(len(y)), y], 1e-9)).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(logits / heat)
    right, score = p.argmax(1) == y, p.max(1)
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= PRECISION)
    return heat, float(score[order][good[-1]]) if len(good) else 1.0


def predict(model: dict | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and calibrated scores of whole texts."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    for i, text in enumerate(texts):
        if model is None or text is None or not _HAS_LETTER.search(text):
            continue
        total, n = np.zeros(len(model["langs"])), 0
        for block in blocks(_lowered(text)):
            g = grams(block)
            total += model["scores"][g].sum(0, dtype=np.float64)
            n += len(g)
        p = _softmax((total / max(n, 1) + model["bias"]) / model["heat"])
        best = int(p.argmax())
        langs[i], scores[i] = model["langs"][best], min(1.0, float(p[best]))
    return langs, scores


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted (score reaches the rejection threshold).

    Learns from documents with a language whose crc32(id) mod 5 is not 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket("doc_id", 5) != 0))
    held = docs.sparkSession.sparkContext.broadcast(fit(training_rows(known, "lang", PER_LANG, MAX_CHARS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict(held.value, b.column(1).to_pylist())
            reject = held.value["reject"] if held.value else 1.0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array((scores >= reject) & (scores > 0))],
                names=["doc_id", "lang_pred", "score", "accepted"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = map_batches(rows.select("doc_id", "text"), run,
                      f"doc_id {id_type}, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")
