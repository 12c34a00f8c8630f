from datetime import datetime

from pyspark.sql import functions as F

from leadlens.operators import identity as I
from leadlens.operators import leads as LD
from tests.conftest import rows

D = datetime(2024, 1, 1)
PARENTS = ("id long, name string, phone string, email string, marketing_consent boolean, consent_text_version string, "
           "consented_at timestamp_ntz, lead_status string, admin_notes string, created_at timestamp_ntz")
CONTACTS = ("contact_id long, child_id long, phone_raw string, parent_name string, email string, marketing boolean, "
            "consent_version string, ts timestamp_ntz")


def test_upsert_parents_rules(spark):
    parents = spark.createDataFrame([(1, "Old", "+998901234567", "old@x", True, "v0", D, "enrolled", "n", D)], PARENTS)
    c = spark.createDataFrame([
        (10, 100, "901234567", "Ali", None, False, "v1", datetime(2024, 2, 1)),          # existing phone, no email
        (11, 101, "+998 90 765 43 21", "Vali", "v@x", True, "v1", datetime(2024, 2, 1)),  # new phone ...
        (12, 102, "0907654321", "Vali2", None, False, "v2", datetime(2024, 2, 2)),         # ... same phone again
        (13, 103, None, "NoPhone1", None, False, "v1", datetime(2024, 2, 3)),
        (14, 104, "", "NoPhone2", None, True, "v1", datetime(2024, 2, 3)),
    ], CONTACTS)
    up = {r["id"]: r for r in I.upsert_parents(parents, I.accepted_contacts(c)).collect()}
    assert len(up) == 4
    old = up[1]
    assert (old["name"], old["email"], old["marketing_consent"], old["lead_status"], old["admin_notes"]) == \
        ("Ali", "old@x", True, "enrolled", "n")          # consent never downgraded, status untouched
    new = up[I.NEW_ID_BASE + 11]
    assert (new["name"], new["email"], new["marketing_consent"], new["consent_text_version"]) == ("Vali2", "v@x", True, "v2")
    assert {up[I.NEW_ID_BASE + 13]["name"], up[I.NEW_ID_BASE + 14]["name"]} == {"NoPhone1", "NoPhone2"}


def test_update_contact_sets_phone_only_when_missing(spark):
    parents = spark.createDataFrame([(1, "A", None, None, False, "v0", D, "new", None, D),
                                     (2, "B", "+998900000002", None, False, "v0", D, "new", None, D)], PARENTS)
    kids = spark.createDataFrame([(100, 1), (200, 2)], "id long, parent_id long")
    c = spark.createDataFrame([(1, 100, "901111111", "A2", "a@x", False, "v1", datetime(2024, 3, 1)),
                               (2, 200, "902222222", "B2", None, True, "v1", datetime(2024, 3, 1))], CONTACTS)
    got = {r["id"]: r for r in I.update_contact(parents, I.accepted_contacts(c), kids).collect()}
    assert got[1]["phone"] == "+998901111111" and got[1]["email"] == "a@x"
    assert got[2]["phone"] == "+998900000002" and got[2]["marketing_consent"] is True


def test_patch_leads(spark):
    parents = spark.createDataFrame([(1, "A", None, None, False, "v0", D, "new", "old", D)], PARENTS)
    p = spark.createDataFrame([(1, 1, "Yozildi", None, datetime(2024, 1, 1)), (2, 1, "bad", "ignored", datetime(2024, 1, 2)),
                               (3, 1, None, "x" * 5000, datetime(2024, 1, 3))],
                              "patch_id long, parent_id long, lead_status_text string, admin_notes string, ts timestamp_ntz")
    out, rej = I.patch_leads(parents, p)
    r = out.collect()[0]
    assert r["lead_status"] == "enrolled" and len(r["admin_notes"]) == 4000
    assert rows(rej, "patch_id", "reason") == [(2, "bad_status")]


def test_csv_cells(spark):
    df = spark.createDataFrame([("=SUM(A1)",), ("+1",), ("-x",), ("@a",), ("\tt",), ("\rr",), ('a"b,c\nd',), (None,)], "v string")
    got = [r[0] for r in df.select(LD.csv_cell(F.col("v"))).collect()]
    assert got == ['"\'=SUM(A1)"', '"\'+1"', '"\'-x"', '"\'@a"', '"\'\tt"', '"\'\rr"', '"a""b,c\nd"', '""']


def test_model_audit(spark):
    s = spark.createDataFrame([("1", "claude-x"), ("2", "vendor/m"), ("3", ""), ("4", None)], "id string, model string")
    assert rows(I.model_audit(s, "openrouter").orderBy("id"), "id", "effective_model") == \
        [("1", I.OPENROUTER_DEFAULT_MODEL), ("3", I.OPENROUTER_DEFAULT_MODEL), ("4", I.OPENROUTER_DEFAULT_MODEL)]
    assert rows(I.model_audit(s, "anthropic").orderBy("id"), "id") == [("2",), ("3",), ("4",)]


def test_write_leads_csv_file(spark):
    import glob
    import tempfile
    lines = spark.createDataFrame([(2, datetime(2024, 1, 2), '"b"'), (1, datetime(2024, 1, 2), '"a"'),
                                   (3, datetime(2024, 1, 5), '"c"')], "id long, created_at timestamp_ntz, csv_line string")
    d = tempfile.mkdtemp(prefix="csv-test-")
    lines = lines.unionByName(spark.createDataFrame([(4, None, '"d"')], lines.schema))
    LD.write_leads_csv(lines, d + "/out", files=3)
    parts = sorted(glob.glob(d + "/out/part-*"))
    assert len(parts) > 1  # ranges of lines, written side by side
    text = "".join(open(p, encoding="utf-8").read() for p in parts)
    assert text.startswith("\ufeff\"Ota-ona\",\"Telefon\"")
    assert text.split("\n")[1:] == ['"c"', '"a"', '"b"', '"d"', ""]  # the text writer ends the last line too


def test_list_places_over_many_partitions(spark):
    """One date holds most leads, so the list is one key; places still come from all partitions."""
    leads = spark.range(500).select("id", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, datetime(2024, 1, 3))
                                    .otherwise(datetime(2024, 1, 2)).cast("timestamp_ntz").alias("created_at")).repartition(5)
    got = {r.id: r.pos for r in LD.leads_sorted(leads).collect()}
    want = sorted(range(500), key=lambda i: (2 if i % 7 == 0 else 0 if i % 5 == 0 else 1, i))
    assert got == {i: k + 1 for k, i in enumerate(want)}


def test_minimized_view_allow_list(spark):
    from leadlens.operators.conversations import minimized_llm_view
    kids = spark.createDataFrame([(1, 5, "Ali", 2, 7, "goal", "notes", D)],
                                 "id long, parent_id long, nickname string, grade int, age int, goal string, notes string, created_at timestamp_ntz")
    v = minimized_llm_view(kids)
    assert set(v.columns) == {"child_id", "nickname", "grade", "age", "band", "intro"}
    intro = v.collect()[0]["intro"]
    assert "Ali" in intro and "2-sinf (A guruh" in intro and "Yoshi: 7" in intro
    assert "goal" not in intro and "notes" not in intro


def test_update_contact_phone_clash_is_reported(spark):
    parents = spark.createDataFrame([(1, "A", None, None, False, "v0", D, "new", None, D),
                                     (2, "B", "+998901111111", None, False, "v0", D, "new", None, D)], PARENTS)
    kids = spark.createDataFrame([(100, 1)], "id long, parent_id long")
    c = spark.createDataFrame([(1, 100, "901111111", "A2", None, False, "v1", datetime(2024, 3, 1))], CONTACTS)
    up = I.update_contact(parents, I.accepted_contacts(c), kids)
    clash = rows(I.phone_conflicts(up), "phone", "parents")
    assert clash == [("+998901111111", 2)]


def test_lead_filters(spark):
    from leadlens.sources.adapters import ts_lit
    parents = spark.createDataFrame([(1, "A", None, None, False, "v0", D, "new", None, datetime(2001, 11, 1)),
                                     (2, "B", None, None, False, "v0", D, "enrolled", None, datetime(2001, 1, 1))], PARENTS)
    kids = spark.createDataFrame([(10, 1, 2), (11, 1, 3), (20, 2, 3)], "id long, parent_id long, grade int")
    asof = ts_lit("2001-11-05 00:00:00")
    ids = lambda **kw: sorted(r[0] for r in rows(LD.filter_parents(parents, kids, asof, **kw), "id"))
    assert ids(status="Yozildi") == [2] and ids(status="nonsense") == [1, 2] and ids(status="all") == [1, 2]
    assert ids(grade="2") == [1] and ids(grade="3abc") == [1, 2] and ids(grade="all") == [1, 2]
    assert ids(since_days="4") == [1] and ids(since_days="3") == []


def test_write_documents_json_lines(spark):
    import glob
    import json
    import tempfile
    docs = spark.createDataFrame([("a", '{"x": 1}'), ("b", '{"x": null}')], "k string, doc string")
    d = tempfile.mkdtemp(prefix="docs-test-")
    LD.write_documents(docs, d + "/out")
    lines = [ln for p in glob.glob(d + "/out/part-*") for ln in open(p, encoding="utf-8").read().splitlines()]
    assert sorted(json.loads(ln)["x"] or 0 for ln in lines) == [0, 1]


def test_resubmission_of_one_child_in_a_batch(spark):
    """The second submission of a child updates the family that the first one made."""
    from datetime import datetime

    parents = spark.createDataFrame(
        [], "id long, name string, phone string, email string, marketing_consent boolean, consent_text_version string, "
            "consented_at timestamp_ntz, lead_status string, admin_notes string, created_at timestamp_ntz")
    children = spark.createDataFrame([(1, None), (2, None)], "id long, parent_id long")
    t = [datetime(2024, 1, d) for d in range(1, 6)]
    contacts = spark.createDataFrame(
        [(10, 1, "Ona", "+998901234567", None, False, "v1", t[0]), (11, 1, "Ota", "+998907654321", "a@b.uz", True, "v2", t[1]),
         (12, 2, "X", None, None, False, "v1", t[2]), (13, 2, "Y", None, None, True, "v1", t[3])],
        "contact_id long, child_id long, parent_name string, phone string, email string, marketing boolean, "
        "consent_version string, ts timestamp_ntz")
    up, kids = I.submit_contacts(parents, children, contacts)
    up = {r.id: r for r in up.collect()}
    assert len(up) == 2 and kids.count() == 2
    first, second = (up[r.parent_id] for r in kids.orderBy("id").collect())
    assert (first.name, first.phone, first.email, first.marketing_consent) == ("Ota", "+998901234567", "a@b.uz", True)
    assert (second.name, second.phone, second.marketing_consent) == ("Y", None, True)


def test_submissions_are_computed_once(spark):
    """With ``write`` nothing after the first step computes the contacts or the upserted parents again."""
    from datetime import datetime

    t = [datetime(2024, 1, d) for d in range(1, 6)]
    parents = spark.createDataFrame(
        [(5, "Old", "+998901234567", None, False, "v0", t[0], "new", None, t[0])],
        "id long, name string, phone string, email string, marketing_consent boolean, consent_text_version string, "
        "consented_at timestamp_ntz, lead_status string, admin_notes string, created_at timestamp_ntz")
    children = spark.createDataFrame([(1, None), (2, None), (3, 5)], "id long, parent_id long")
    contacts = spark.createDataFrame(
        [(10, 1, "Ona", "+998901234567", None, False, "v1", t[0]), (11, 1, "Ota", "+998907654321", "a@b.uz", True, "v2", t[1]),
         (12, 2, "X", None, None, False, "v1", t[2]), (12, 2, "X", None, None, False, "v1", t[2]),
         (13, None, "Y", None, None, True, "v1", t[3])],
        "contact_id long, child_id long, parent_name string, phone string, email string, marketing boolean, "
        "consent_version string, ts timestamp_ntz").withColumn("parent_name", F.reverse(F.reverse("parent_name")))
    want, got = I.submit_contacts(parents, children, contacts), I.submit_contacts(parents, children, contacts, write=True)
    for a, b in zip(want, got):
        assert a.columns == b.columns and sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (want[0], *got)]
    assert ["reverse(" in p for p in plans] == [True, False, False]
