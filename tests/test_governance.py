from datetime import datetime

from pyspark.sql import functions as F

from leadlens.operators import governance as G
from leadlens.operators import metrics as M
from leadlens.sources.adapters import ts_lit
from tests.conftest import rows

AS_OF = "2024-03-31 00:00:00"   # month end: 24 months back is 2022-03-31


def test_purge_edges(spark):
    cut = datetime(2022, 3, 31)
    children = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30), (5, None)], "id long, parent_id long")
    sessions = spark.createDataFrame([
        ("s1", 1, datetime(2020, 1, 1), None),      # old, never finished -> expired
        ("s2", 2, cut, None),                        # exactly on the cut-off -> stays
        ("s3", 3, datetime(2020, 1, 1), datetime(2023, 1, 1)),  # finished recently -> stays
    ], "id string, child_id long, started_at timestamp_ntz, finished_at timestamp_ntz")
    parents = spark.createDataFrame([(10, "+1"), (20, None), (30, "+3"), (40, None)], "id long, phone string")
    messages = spark.createDataFrame([("s1", 1)], "session_id string, id long")
    reports = spark.createDataFrame([("s1", 1)], "session_id string, child_id long")
    after, audit = G.retention_purge(parents, children, sessions, messages, reports, ts_lit(AS_OF), 24)
    assert sorted(r[0] for r in rows(after["children"], "id")) == [2, 3, 4, 5]   # 4, 5: no session -> stay
    assert sorted(r[0] for r in rows(after["parents"], "id")) == [10, 20, 30]    # 40: orphan, goes
    assert rows(after["messages"]) == [] and rows(after["reports"]) == []
    assert dict(rows(audit, "table", "removed")) == {"parents": 1, "children": 1, "sessions": 1, "messages": 1, "reports": 1}


def test_erase_unknown_and_no_orphans(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    children = spark.createDataFrame([(10, 1), (20, 2)], "id long, parent_id long")
    sessions = spark.createDataFrame([("s", 10)], "id string, child_id long")
    messages = spark.createDataFrame([("s", 1)], "session_id string, id long")
    reports = spark.createDataFrame([("s", 10)], "session_id string, child_id long")
    req = spark.createDataFrame([(1,), (99,)], "parent_id long")
    after, audit, nf = G.erase_parents(parents, children, sessions, messages, reports, req)
    assert rows(nf) == [(99,)]
    assert rows(after["children"], "id") == [(20,)] and rows(after["sessions"]) == [] and rows(after["messages"]) == []


def test_weekly_funnel_clock_edges(spark):
    a = datetime(2024, 1, 31)
    from datetime import timedelta as td
    ev = spark.createDataFrame([
        ("started", a), ("started", a - td(days=7) + td(microseconds=1)), ("started", a - td(days=7)),
        ("finished", a - td(days=28)), ("finished", a - td(days=28) + td(microseconds=1)),
        ("contact", a + td(seconds=1)), ("contact", None),
    ], "metric string, ts timestamp_ntz")
    got = {r[0]: r[1:] for r in rows(M.weekly_funnel(ev, ts_lit("2024-01-31 00:00:00")))}
    assert got == {0: (2, 0, 0, 0), 1: (1, 0, 0, 0), 2: (0, 0, 0, 0), 3: (0, 1, 0, 0)}


def test_dq_session_requests(spark):
    req = spark.createDataFrame([
        (1, False, "a", "1", None, None, None), (2, True, "  ", "1", None, None, None), (3, True, "a" * 61, "1", None, None, None),
        (4, True, "a", "5", None, None, None), (5, True, "a", "3abc", "2", None, None), (6, True, " a ", "2", "", " g ", "  "),
    ], "request_id long, consent boolean, nickname string, grade string, age string, goal string, notes string")
    got = {r[0]: r[1:] for r in rows(G.dq_session_requests(req), "request_id", "reason", "nickname", "grade", "goal", "notes")}
    assert got[1][0] == "consent_required" and got[2][0] == "required" and got[3][0] == "too_long"
    assert got[4][0] == "bad_grade" and got[5][0] == "bad_age"
    assert got[6] == (None, "a", 2, "g", None)


def test_dq_messages_finished_session(spark):
    m = spark.createDataFrame([
        ("s1", 1, "user", "salom", datetime(2024, 1, 1)), ("s1", 2, "user", "kech", datetime(2024, 1, 3)),
        ("s2", 3, "user", "   ", datetime(2024, 1, 1)), ("s2", 4, "user", "x" * 11, datetime(2024, 1, 1)),
        ("s2", 5, "assistant", "", datetime(2024, 1, 1))],
        "session_id string, id long, role string, content string, created_at timestamp_ntz")
    sess = spark.createDataFrame([("s1", datetime(2024, 1, 2)), ("s2", None)], "id string, finished_at timestamp_ntz")
    got = dict(rows(G.dq_messages(m, max_chars=10, sessions=sess), "id", "reason"))
    assert got == {1: None, 2: "session_finished", 3: "required", 4: "too_long"}


def test_a_failed_write_publishes_nothing(spark):
    import uuid

    import pytest

    from leadlens.sources import snapshots as SN
    prefix = f"publish_{uuid.uuid4().hex}"
    first = {"a": spark.range(3), "b": spark.range(2)}
    SN.write_tables(first, prefix)
    broken = spark.range(3).select(F.raise_error(F.lit("crash")).alias("id"))
    with pytest.raises(Exception, match="crash"):
        SN.write_tables({"a": spark.range(9), "b": broken}, prefix)
    now = SN.published(spark, prefix)
    assert {n: t.count() for n, t in now.items()} == {"a": 3, "b": 2}
    SN.write_tables({"a": spark.range(5), "b": spark.range(5)}, prefix)
    assert {n: t.count() for n, t in SN.published(spark, prefix).items()} == {"a": 5, "b": 5}


def test_cascade_by_bitmaps_equals_joins_without_a_shuffle(spark, monkeypatch):
    """Negative, large and repeated ids, null keys; scattered or non-integer ids go back to the joins."""
    ids = [0, 1, -1, 7, 8, 32767, 32768, 32769, -32768, -32769, 2 ** 40, 2 ** 40 + 9]
    gone = spark.createDataFrame([(i,) for i in ids[::2]] + [(1,), (1,), (None,)], "id long")
    children = spark.createDataFrame([(i, None) for i in ids] + [(None, 5)], "id long, parent_id long")
    sessions = spark.createDataFrame([(f"s{i}", i) for i in ids] * 2 + [("s-null", None)], "id string, child_id long")
    messages = spark.createDataFrame([(f"s{i}", n) for n, i in enumerate(ids)], "session_id string, id long")
    reports = spark.createDataFrame([("r", i, i) for i in [*ids, None]], "share_token string, child_id long, n long")
    marks = G.id_marks(gone)
    want = G.cascade_children(children, sessions, messages, reports, gone)
    got = G.cascade_children(children, sessions, messages, reports, gone, marks)
    for name, rows_ in got.items():
        assert rows_.columns == want[name].columns
        assert sorted(rows_.collect(), key=str) == sorted(want[name].collect(), key=str)
    for name in ("children", "sessions", "reports"):
        plan = got[name]._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("BroadcastExchange")[0]
        assert "SortMergeJoin" not in plan
    monkeypatch.setattr(G, "MOST_MARKS", 3)
    assert G.id_marks(gone) is None and G.id_marks(gone.selectExpr("cast(id as string) as id")) is None


def test_token_outliers_send_no_model_to_one_task(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = spark.range(200).selectExpr("cast(id as string) as id", "'m' as model",
                                        "if(id = 7, 100000L, 10L) as input_tokens", "1L as output_tokens")
        out = M.token_outliers(s)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert rows(out) == [("7", "m", 100001)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
