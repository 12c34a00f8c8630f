"""The pipeline: each stage against brute force on its own input, then the whole on a small corpus."""

import os

import corpus_pipeline as C
import pytest
from helpers import words
from test_decontamination import brute as brute_hits
from test_line_dedup import brute as brute_lines
from test_mixing import brute as brute_mix
from test_simhash import brute_components, brute_fingerprint
from test_toxicity import corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEMS = [(1, " ".join(words(30, 3))), (2, "tiny item")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic documents, a passage of three lines, near copies, a leaked test item and clean documents."""
    at = str(tmp_path_factory.mktemp("corpus"))
    rude = corpus(300, seed=6)
    rows = [(i, t) for i, t, _ in rude]
    labels = [(i, 1, y) for i, _, y in rude]
    clean = [(1000 + i, " ".join(words(10 + i % 70, 100 + i))) for i in range(120)]
    rows += clean
    labels += [(i, 1, 0) for i, _ in clean]
    lines = "\n".join(" ".join(words(20, 50 + k)) for k in range(3))
    rows += [(400, "top\n" + lines + "\nend one"), (401, "other\n" + lines + "\nend two"), (402, lines)]
    rows += [(410, " ".join(words(150, 60))), (411, " ".join(words(150, 60)[:-1] + ["edited"])),
             (420, "before " + " ".join(words(30, 3)[5:20]) + " after"), (421, "a tiny ITEM!"), (430, None), (431, "")]
    full = [(i, t, "en" if i % 2 else "de", f"src{i % 4}", len(t) if t is not None else None) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_equal_brute_force_each_on_its_input(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {i: y for i, _, y in corpus(300, seed=6)}
    for k, (name, stage) in enumerate(C.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(os.path.join(tmp_path, str(k)))
        docs = spark.read.parquet(os.path.join(tmp_path, str(k)))
        after = sorted((tuple(r) for r in docs.collect()), key=repr)
        if name == "toxicity":
            gone = {r[0] for r in before} - {r[0] for r in after}
            assert sum(truth.get(i, 0) for i in gone) >= 0.95 * sum(truth.values())
            assert sum(not truth.get(i, 0) for i in gone) <= 0.1 * len(before)
            assert set(after) <= set(before)
        elif name == "line dedup":
            rest = {r[0]: r[2:4] for r in before}
            chars = {r[0]: r[4] for r in before}
            want = [(i, t, *rest[i], len(t) if n else chars[i]) for i, t, n in brute_lines([r[:2] for r in before])
                    if not n or t.strip(" \t\n\r\x0b\x0c")]
            assert after == sorted(want, key=repr)
            assert 402 not in {r[0] for r in after} and {400, 401, 430, 431} <= {r[0] for r in after}
        elif name == "SimHash near-dedup":
            pairs = brute_components([r[:2] for r in before], [brute_fingerprint(r[1]) for r in before])
            assert [r[0] for r in sorted(after)] == sorted(i for i, c in pairs if i == c)
            assert set(after) <= set(before) and 411 not in {r[0] for r in after}
        elif name == "benchmark decontamination":
            assert after == sorted((r for r in before if not brute_hits(r[1], ITEMS)[1]), key=repr)
            assert not {420, 421} & {r[0] for r in after}
        else:
            domain = lambda s: f"domain{int(s[3:]) % 3}"
            weights = (lambda d: 2 if d == "domain0" else 1, lambda x: 4 if x == "en" else 2, lambda s: 1)
            _, want = brute_mix(before, None, 3, weights, domain, 42)
            got = [(r.doc_id, r.text, r.epoch) for r in docs.collect()]
            assert sorted(got, key=repr) == sorted(want.elements(), key=repr)


def test_run_is_the_stages_in_order(spark, folder):
    out = C.run(spark, folder)
    assert out.columns == [*COLUMNS, "epoch", "domain", "n_tokens"]
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing"]
    ids = {r.doc_id for r in out.collect()}
    assert ids and not ids & {402, 411, 420, 421}


def test_empty_documents(spark, folder, tmp_path):
    at = str(tmp_path / "none")
    os.makedirs(at)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{at}/documents.parquet")
    assert C.run(spark, at).count() == 0
