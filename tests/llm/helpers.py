"""Small tables shared by the operator tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows):
    """rows: (doc_id, text) or full rows."""
    full = [r if len(r) == 5 else (*r, "en", "src1", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def words(n, seed=0):
    """n distinct-looking words; different seeds share none."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [f"{letters[(i // 26) % 26]}{letters[i % 26]}{letters[seed % 26]}{letters[seed // 26 % 26]}q{i // 676}" for i in range(n)]
