import json

from leadlens.operators import reports as R
from tests.conftest import rows

GOOD = '{"levels": {"mantiq": "Kuchli", "psixologiya": "Me\'yorda", "harakat": "shakl"}, "sports": ["Futbol", "Shaxmat"]}'


def fence(body, tag="json"):
    return f"```{tag}\n{body}\n```"


CASES = {
    "none": ("Matn", (None, None, None, [])),
    "one": ("Matn\n" + fence(GOOD), ("kuchli", "meyorda", "shakllanmoqda", ["Futbol", "Shaxmat"])),
    "two_last_wins": (fence('{"levels": {"mantiq": "shakl"}, "sports": ["A"]}') + "\n" + fence(GOOD),
                      ("kuchli", "meyorda", "shakllanmoqda", ["Futbol", "Shaxmat"])),
    "last_invalid": (fence(GOOD) + "\n" + fence('{"levels": {"mantiq": "kuchli"},}'), (None, None, None, [])),
    "unterminated": ("Matn\n```json\n" + GOOD, (None, None, None, [])),
    "upper": (fence(GOOD, "JSON"), ("kuchli", "meyorda", "shakllanmoqda", ["Futbol", "Shaxmat"])),
    "levels_not_object": (fence('{"levels": "kuchli", "sports": ["A"]}'), (None, None, None, ["A"])),
    "sports_not_array": (fence('{"levels": {"mantiq": "kuchli"}, "sports": "A"}'), ("kuchli", None, None, [])),
    "sports_mixed": (fence('{"sports": ["", 1, null, "B"]}'), (None, None, None, ["1", "null", "B"])),
    "top_array": (fence('[1, 2]'), (None, None, None, [])),
    "single_quotes": (fence("{'levels': {'mantiq': 'kuchli'}}"), (None, None, None, [])),
    "trailing_text": (fence('{"levels": {"mantiq": "kuchli"}} x'), (None, None, None, [])),
    "truncated": (fence('{"levels": {"mantiq": "kuch'), (None, None, None, [])),
    "nan": (fence('{"levels": {"mantiq": NaN}}'), (None, None, None, [])),
    "duplicate_keys": (fence('{"levels": {"mantiq": "shakl"}, "levels": {"mantiq": "kuchli"}}'),
                       ("kuchli", None, None, [])),
}


def parsed(spark, texts):
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "session_id string, raw_text string")
    return {r["session_id"]: r for r in R.parse_report(df).collect()}


def test_parse_report_cases(spark):
    got = parsed(spark, {k: v[0] for k, v in CASES.items()})
    for k, (_, exp) in CASES.items():
        r = got[k]
        assert (r["level_logic"], r["level_psych"], r["level_activity"], list(r["sports"])) == exp, k


def test_fence_cut_and_markers(spark):
    text = ("[YAKUN: MANTIQ]\nSalom\n\n[YAKUN: HARAKAT]\nOxiri [yakun:psixologiya]\n"
            + fence('{"levels": {}}') + "\nkeyin\n" + fence("{bad"))
    r = parsed(spark, {"a": text})["a"]
    # Last fence is cut even though its JSON is bad; the first stays; marker-only
    # lines go, the blank line before one survives, inline markers are removed.
    assert r["content_md"] == "Salom\n\nOxiri \n" + fence('{"levels": {}}') + "\nkeyin"
    assert r["level_logic"] is None and list(r["sports"]) == []


def test_sections_bullets_cards(spark):
    md = "## A\n- **Mantiq** — yaxshi\nmatn\n\n## B\n1. Kitob\n2. Sport\n## C"
    df = spark.createDataFrame([("s", md)], "session_id string, content_md string")
    secs = rows(R.report_sections(df).orderBy("ord"), "ord", "heading", "body")
    assert secs == [(1, "A", "- **Mantiq** — yaxshi\nmatn\n\n"), (2, "B", "1. Kitob\n2. Sport\n")]
    bl = rows(R.report_bullets(R.report_sections(df)).orderBy("section", "line_no"), "kind", "name", "text")
    assert bl == [("bullet", "Mantiq", "yaxshi"), ("numbered", "1", "Kitob"), ("numbered", "2", "Sport")]
    msgs = spark.createDataFrame([(1, 10, "assistant", "> Savol\n>  javob\nkatta matn"), (1, 11, "user", "> x")],
                                 "session_id long, id long, role string, content string")
    assert rows(R.child_facing_cards(msgs).orderBy("card_no"), "card") == [("Savol",), (" javob",)]


def test_first_report_wins(spark):
    from datetime import datetime as dt
    a = spark.createDataFrame([("s1", "b", dt(2024, 1, 1, 0, 0, 1)), ("s1", "a", dt(2024, 1, 1, 0, 0, 1)),
                               ("s1", "c", dt(2024, 1, 1)), ("s2", "z", dt(2024, 1, 2))],
                              "session_id string, share_token string, created_at timestamp_ntz")
    got = dict(rows(R.first_report_wins(a), "session_id", "share_token"))
    assert got == {"s1": "c", "s2": "z"}


def test_greeting_audit(spark):
    from datetime import datetime
    m = spark.createDataFrame([
        (1, 1, "assistant", "> Salom!\n" + "x" * 60, datetime(2024, 1, 1)),
        (1, 2, "assistant", "[YAKUN: MANTIQ]", datetime(2024, 1, 2)),
        (2, 3, "assistant", "qisqa [YAKUN: HARAKAT]", datetime(2024, 1, 1)),
    ], "session_id long, id long, role string, content string, created_at timestamp_ntz")
    got = {r[0]: r[1:] for r in rows(R.greeting_audit(m), "session_id", "greeting_ok", "has_card", "no_early_marker", "ok")}
    assert got == {1: (True, True, True, True), 2: (False, False, False, False)}


def test_markers_with_unicode_space_object_levels_and_audit(spark):
    text = "a\n[YAKUN: MANTIQ]\nb [yakun: HARAKAT ] c"
    fence = '```json\n{"levels": {"mantiq": {"daraja": "Kuchli"}, "harakat": "Kuchli"}}\n```'
    raw = spark.createDataFrame([("s", text + "\n" + fence, False)], "session_id string, raw_text string, partial boolean")
    r = R.parse_report(raw).first()
    assert r.content_md == "a\nb  c" and r.level_logic is None and r.level_activity == "kuchli"
    parsed = spark.createDataFrame([("s", "## A\nx\n## B\ny\n## C", None, None, None, False), ("t", "[Yakun: SPORT]", None, None, None, False)],
                                   "session_id string, content_md string, level_logic string, level_psych string, "
                                   "level_activity string, partial boolean")
    got = {x.session_id: x for x in R.report_quality_audit(parsed).collect()}
    assert got["s"].sections == 3 and got["s"].no_marker_left and not got["t"].no_marker_left
