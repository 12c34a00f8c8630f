from datetime import datetime, timedelta

from leadlens.operators import conversations as C
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
SCHEMA = "session_id long, id long, role string, content string, meta boolean, created_at timestamp_ntz"


def log(spark, items):
    """items: (session, role, content, meta) in order; ids and times increase."""
    return spark.createDataFrame([(s, i, r, c, m, T0 + timedelta(minutes=i // 2)) for i, (s, r, c, m) in enumerate(items)],
                                 SCHEMA)


def test_merge_turns_edges(spark):
    m = log(spark, [
        (1, "assistant", "salom", False), (1, "user", "a", False), (1, "user", None, False), (1, "assistant", "b", False),
        (2, "system", "intro", True), (2, "user", "x", False), (2, "assistant", "y", False),
        (3, "assistant", "yolg'iz", False),
    ])
    got = rows(C.merge_turns(m).orderBy("session_id", "turn"), "session_id", "role", "content")
    assert got == [(1, "user", "a\n\n"), (1, "assistant", "b"), (2, "user", "intro\n\nx"), (2, "assistant", "y")]


def test_gate_and_premature(spark):
    from leadlens.operators.reports import premature_markers
    m = log(spark, [
        (1, "system", "intro", True), (1, "assistant", "[YAKUN: MANTIQ][YAKUN: HARAKAT]", False),
        (2, "user", "meta", True), (2, "assistant", "ok", False),
        (3, "user", "javob", False), (3, "assistant", "[YAKUN: MANTIQ]", False),
    ])
    gate = {r[0]: (r[1], r[2]) for r in rows(C.engagement_gate(m))}
    assert gate == {1: (0, False), 2: (0, False), 3: (1, True)}
    pm = rows(premature_markers(C.progress_from_messages(m), C.engagement_gate(m)), "session_id")
    assert pm == [(1,)]


def test_turn_cap_and_last_turn(spark):
    m = log(spark, [(1, "user", "a", False), (1, "assistant", "b", False), (1, "user", "c", False),
                    (1, "assistant", "d", False), (1, "user", "e", True)])
    cap = rows(C.turn_cap(m, cap=2).orderBy("id"), "turns_before", "over_cap")
    assert cap == [(0, False), (0, False), (1, False), (1, False), (2, True)]
    d = rows(C.dangling_user_turn(m), "last_role", "pending", "needs_report_request")
    assert d == [("user", True, False)]


def test_cap_notice_is_not_a_turn(spark):
    from leadlens.functions.exprs import CAP_REPLY
    m = log(spark, [(1, "user", "a", False), (1, "assistant", "b", False), (1, "user", "c", False),
                    (1, "assistant", CAP_REPLY, False), (1, "user", "d", False)])
    assert rows(C.session_counters(m), "turn_count") == [(1,)]
    assert [r[0] for r in rows(C.turn_cap(m, cap=5).orderBy("id"), "turns_before")] == [0, 0, 1, 1, 1]
