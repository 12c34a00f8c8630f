"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts are normalised to words: A-Z lower-cased, then runs of digits, letters a-z and anything beyond ASCII. Each
``window`` consecutive words of an item are a pattern (an item with fewer words is one pattern), and the automaton
reads word numbers, so each text is scanned once and matches end at word borders. Hit words are mapped back to
character offsets of the original text.

Benchmarks are small beside the corpus, but nothing relies on it: items are dealt into shards of a bounded number of
characters, and each shard has its own automaton and pass.

Edge cases: null or word-less texts have no words and no hits; items without words match nothing; a null item_id
counts for hits, but is not listed; an item repeated in the table is listed once; an empty benchmark hits nothing;
overlapping matches count each word once; repeated documents are repeated in the result.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

WINDOW = 10
#: Characters of benchmark text for which one automaton is built and broadcast.
SHARD_CHARS = 8_000_000

_KEPT = (string.digits + string.ascii_lowercase).encode()
_WORD_BYTES = bytes(b if b >= 0x80 or b in _KEPT else b + 32 if chr(b) in string.ascii_uppercase else 32
                    for b in range(256))
#: The words of an original text, upper case included; positions equal those of the normalised text.
_WORD_AT = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

SPAN = "struct<first_word:long,last_word:long,start:long,end:long>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def build_automaton(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> tuple[dict, Any]:
    """(word numbers, automaton over windows); each pattern carries its length and the ids of its items."""
    numbers: dict[bytes, int] = {}
    patterns: dict[tuple, set] = {}
    for item, text in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words(text)]
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            patterns.setdefault(tuple(ids[at:at + window]), set()).add(item)
    if not patterns:
        return {}, None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for pattern, found in patterns.items():
        automaton.add_word(pattern, (len(pattern), sorted(x for x in found if x is not None)))
    automaton.make_automaton()
    return numbers, automaton


def scan(tokens: list[bytes], numbers: dict, automaton: Any, hits: bytearray, items: set) -> None:
    """Mark hit words in ``hits`` (one byte a word) and add the items found."""
    if automaton is None or not tokens:
        return
    for end, (length, found) in automaton.iter(tuple([numbers.get(w, 0) for w in tokens])):
        hits[end - length + 1:end + 1] = b"\x01" * length
        items.update(found)


def spans(text: str, hits: bytes) -> list[dict]:
    """Runs of hit words, with character offsets (end exclusive) in the original text."""
    at = [m.span() for m in _WORD_AT.finditer(text)]
    return [{"first_word": m.start(), "last_word": m.end() - 1, "start": at[m.start()][0], "end": at[m.end() - 1][1]}
            for m in re.finditer(rb"\x01+", hits)]


def automata(benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS, text_col: str = "text",
             id_col: str = "item_id") -> list[Broadcast]:
    """One broadcast automaton per shard of the benchmark; one in all unless the benchmark is large."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // shard_chars))
    shard = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(build_automaton([(r.item, r.text) for r in items.where(shard == k).collect()], window))
            for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS,
                  text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted strings) and the hit spans."""
    shards = automata(benchmark, window, shard_chars)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    between = "doc_id {}, text string, hits binary, items array<string>".format(rows.schema["doc_id"].dataType.simpleString())
    out = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, " \
          f"spans array<{SPAN}>"

    def run(held: Broadcast, last: bool):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, automaton = held.value
            for b in batches:
                marks, found, reports = [], [], []
                for i in range(b.num_rows):
                    text = b.column(1)[i].as_py()
                    tokens = words(text)
                    before = b.num_columns > 2
                    hits = bytearray(b.column(2)[i].as_py()) if before else bytearray(len(tokens))
                    items = set(b.column(3)[i].as_py()) if before else set()
                    scan(tokens, numbers, automaton, hits, items)
                    found.append(sorted(items))
                    marks.append(bytes(hits))
                    if last:
                        reports.append(spans(text, bytes(hits)) if any(hits) else [])
                items = pa.array(found, pa.list_(pa.string()))
                if last:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(map(len, marks), pa.int64()),
                         pa.array((m.count(1) for m in marks), pa.int64()), items,
                         pa.array(reports, pa.list_(pa.struct([(k, pa.int64()) for k in
                                                               ("first_word", "last_word", "start", "end")])))],
                        names=["doc_id", "n_words", "n_hit", "items", "spans"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.binary()), items],
                                                     names=["doc_id", "text", "hits", "items"])
        return step

    for held in shards[:-1]:
        rows = written(map_batches(rows, run(held, False), between), "contamination")
    return map_batches(rows, run(shards[-1], True), out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS,
                  text_col: str = "text") -> DataFrame:
    """The documents, all columns, in which no window of any item occurs. A map without a shuffle."""
    at = docs.columns.index(text_col)

    def run(held: Broadcast):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, automaton = held.value
            for b in batches:
                clean = []
                for text in b.column(at):
                    tokens = words(text.as_py())
                    hits = bytearray(len(tokens))
                    scan(tokens, numbers, automaton, hits, set())
                    clean.append(not any(hits))
                yield b.filter(pa.array(clean, pa.bool_()))
        return step

    for held in automata(benchmark, window, shard_chars):
        docs = map_batches(docs, run(held), docs.schema)
    return docs
