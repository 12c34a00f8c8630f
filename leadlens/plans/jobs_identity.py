"""Identity, change and governance jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.operators import governance as G
from leadlens.operators import identity as I
from leadlens.operators import reports as R
from leadlens.plans.catalog import entity_as_of, job
from leadlens.sources import adapters as A

BASE_URL = "https://example.uz/"
BOT = "@example_bot"


def _unlinked_contacts(t):
    """Accepted contact submissions of children not linked to a parent yet."""
    kids = A.children(t).filter(F.col("parent_id").isNull()).select(F.col("id").alias("child_id"))
    return I.accepted_contacts(A.contacts(t)).join(kids, "child_id", "left_semi")


@job("standardize_contacts", spread=True)
def standardize_contacts(t):
    return I.standardize_contacts(A.contacts(t))


@job("upsert_parents", spread=True)
def upsert_parents(t):
    return I.submit_contacts(A.parents(t), A.children(t), _unlinked_contacts(t), write=True)[0]


@job("link_children", spread=True)
def link_children(t):
    return I.submit_contacts(A.parents(t), A.children(t), _unlinked_contacts(t), write=True)[1].select("id", "parent_id")


@job("update_contact", spread=True)
def update_contact(t):
    return I.update_contact(A.parents(t), I.accepted_contacts(A.contacts(t)), A.children(t))


@job("patch_leads")
def patch_leads(t):
    out, _ = I.patch_leads(A.parents(t), A.lead_patches(t))
    return out.select("id", "lead_status", "admin_notes")


@job("patch_rejects")
def patch_rejects(t):
    """Admin patches that change nothing, as their status is none of the list."""
    return I.patch_leads(A.parents(t), A.lead_patches(t))[1]


@job("apply_turns")
def apply_turns(t):
    return I.apply_turns(A.sessions(t), A.turn_log(t))


@job("finish_sessions")
def finish_sessions(t):
    # A quarter of the sessions is still open when their reports arrive.
    is_open = F.col("child_id") % 4 == 0
    sessions = A.sessions(t).withColumns({
        "status": F.when(is_open, F.lit("active")).otherwise(F.col("status")),
        "finished_at": F.when(~is_open, F.col("finished_at"))})
    return I.finish_sessions(sessions, R.first_report_wins(A.report_attempts(t)))


@job("insert_report_if_absent")
def insert_report_if_absent(t):
    existing = A.reports(t, extra=(F.col("l_returnflag").alias("_flag"),)).filter(F.col("_flag") != "A")
    return I.insert_report_if_absent(existing, A.report_attempts(t))


@job("delivery_targets")
def delivery_targets(t):
    return I.delivery_targets(A.reports(t), A.children(t), A.parents(t), BASE_URL, BOT)


def webhook_tokens(t):
    """Parsed webhook updates: the /start token (if any) and the update time."""
    from leadlens.streaming.delivery import parse_updates
    return parse_updates(A.delivery_updates(t))


@job("mark_delivered", spread=True)
def mark_delivered(t):
    from leadlens.streaming.delivery import match_updates
    matched, _ = match_updates(webhook_tokens(t), A.reports(t))
    return I.mark_delivered(A.reports(t), matched.select("token", "ts"))


@job("model_audit")
def model_audit(t):
    return I.model_audit(A.sessions(t), "openrouter")


@job("llm_call_outcomes")
def llm_call_outcomes(t):
    return I.llm_call_outcomes(A.call_log(t))


@job("last_activity")
def last_activity(t):
    return G.last_activity(A.sessions(t))


@job("children_expired")
def children_expired(t):
    return G.children_expired(A.sessions(t), entity_as_of(), 24)


@job("orphan_parents")
def orphan_parents(t):
    return G.orphan_parents(A.parents(t), A.children(t)).select("id", "name", "phone")


@job("retention_purge")
def retention_purge(t):
    _, audit = G.retention_purge(A.parents(t), A.children(t), A.sessions(t), A.session_messages(t), A.reports(t),
                                 entity_as_of(), 24, write=True)
    return audit


@job("erase_parents")
def erase_parents(t):
    _, audit, not_found = G.erase_parents(A.parents(t), A.children(t), A.sessions(t), A.session_messages(t),
                                          A.reports(t), A.erasure_requests(t), write=True)
    nf = not_found.agg(F.count(F.lit(1)).alias("before")).select(
        F.lit("not_found").alias("table"), "before", F.lit(0).cast("long").alias("after"),
        F.col("before").alias("removed"))
    return audit.unionByName(nf)


@job("dq_session_requests")
def dq_session_requests(t):
    return G.dq_session_requests(A.session_requests(t))


@job("dq_messages")
def dq_messages(t):
    # Some messages are blank, others up to four times as long, to fall on both sides of the product's 2,000.
    content = F.when(F.col("id") % 11 == 0, F.lit(" ")).otherwise(F.expr("repeat(content, cast(1 + id % 4 as int))"))
    return G.dq_messages(A.messages(t).withColumn("content", content))


@job("dq_contacts", spread=True)
def dq_contacts(t):
    return G.dq_contacts(A.contacts(t))


def _broken_entities(t):
    """The tables with a violation of every rule: a few rows of each thousand children get a wrong value."""
    child, of = F.col("id") % 1000, F.col("child_id") % 1000

    def put(c, where, value):
        return F.when(where, value).otherwise(F.col(c))

    null = F.lit(None)
    parents = A.parents(t).withColumns({
        "lead_status": F.when(F.col("id") % 500 == 3, "lost").when(F.col("id") % 500 != 4, F.col("lead_status")),
        "phone": put("phone", F.col("id") % 500 == 5, F.lit("+998900000000")), "name": put("name", F.col("id") % 500 == 6, null)})
    children = A.children(t).withColumns({
        "grade": put("grade", child == 7, F.lit(9)), "age": put("age", child == 11, F.lit(40)),
        "nickname": put("nickname", child == 13, null), "parent_id": put("parent_id", child == 17, F.lit(-1))})
    sessions = A.sessions(t).withColumns({
        "status": F.when(of == 19, "lost").when(of != 20, F.col("status")),
        "session_token": F.when(of == 29, "same").when(of != 30, F.col("session_token")),
        "child_id": F.when(of == 23, F.lit(-5)).when(of != 24, F.col("child_id"))})
    reports = A.reports(t).withColumns({
        "level_logic": put("level_logic", of == 31, F.lit("zor")), "level_psych": put("level_psych", of == 32, F.lit("zor")),
        "level_activity": put("level_activity", of == 33, F.lit("zor")),
        "session_id": F.when(of == 37, F.concat(F.lit("x"), "session_id")).when(of != 38, F.col("session_id")),
        "share_token": F.when(of == 41, "dup").when(of != 42, F.col("share_token")),
        "child_id": F.when(of == 43, F.lit(-1)).when(of != 44, F.col("child_id"))})
    messages = A.session_messages(t).withColumns({
        "content": put("content", F.col("ord") == 1, null), "id": put("id", F.col("ord") == 2, F.lit(2))})
    return parents, children, sessions, messages, reports


@job("dq_entities")
def dq_entities(t):
    return G.dq_entities(*_broken_entities(t))
