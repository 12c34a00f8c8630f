import random
import re

from helpers import docs, words

from leadlens.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items, n=10):
    ws = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        iw = WORD.findall(lower(body))
        for i in range(max(1, len(iw) - n + 1) if iw else 0):
            pattern = iw[i:i + n]
            for at in range(len(ws) - len(pattern) + 1):
                if ws[at:at + len(pattern)] == pattern:
                    hit |= set(range(at, at + len(pattern)))
                    if item is not None:
                        found.add(str(item))
    return len(ws), len(hit), sorted(found)


def sample():
    r = random.Random(1)
    items = [(k, " ".join(words(30, k))) for k in range(6)]
    items += [(10, "Short item, here!"), (11, ""), (12, None), (13, "--- !!"), (None, " ".join(words(14, 20))),
              (2, " ".join(words(30, 2))), (14, "é È 12 x"), (15, "a a a a a a a a a a a")]
    rows = []
    for k in range(60):
        text = [w for s in range(3) for w in words(25, 30 + k + s)]
        if k % 2:
            part = words(30, k % 6)[r.randrange(15):]
            text[10:10] = part[:r.randrange(8, 14)]
        if k % 5 == 0:
            text += ["short", "item", "here"]
        sep = r.choice([" ", ", ", "\n", "--", " \x00 "])
        rows.append((k, sep.join(w.upper() if r.random() < 0.3 else w for w in text)))
    rows += [(90, None), (91, ""), (92, "?!"), (93, "a " * 40), (94, "É È 12 X é è 12 x"), (95, " ".join(words(14, 20))),
             (96, "pad " * 50_000 + " ".join(words(30, 4))), (97, rows[1][1]), (97, rows[1][1]), (None, rows[1][1])]
    return items, rows


def tables(spark):
    items, rows = sample()
    return items, rows, spark.createDataFrame(items, "item_id long, text string"), docs(spark, *rows).repartition(3)


def test_equals_brute_force_with_one_and_many_shards(spark):
    items, rows, bench, table = tables(spark)
    want = sorted(((i, *brute(t, items)) for i, t in rows), key=repr)
    for chars in (D.SHARD_CHARS, 400):
        got = D.contamination(table, bench, shard_chars=chars).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == want


def test_spans_point_into_the_original_text(spark):
    items, rows, bench, table = tables(spark)
    texts = dict(rows)
    for r in D.contamination(table, bench).collect():
        assert sum(s.last_word - s.first_word + 1 for s in r.spans) == r.n_hit
        for s in r.spans:
            ws = WORD.findall(lower(texts[r.doc_id]))
            assert WORD.findall(lower(texts[r.doc_id][s.start:s.end])) == ws[s.first_word:s.last_word + 1]


def test_decontaminate_keeps_clean_documents_and_columns(spark):
    items, rows, bench, table = tables(spark)
    odd = table.selectExpr("*", "1 as hits", "2 as items")
    out = D.decontaminate(odd, bench, shard_chars=400)
    assert out.columns == odd.columns
    clean = sorted((i for i, t in rows if not brute(t, items)[1]), key=repr)
    assert sorted((r.doc_id for r in out.collect()), key=repr) == clean


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.contamination(docs(spark, (1, "a b")), none).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(2, 0, [])]
    assert D.contamination(docs(spark), none).count() == 0
