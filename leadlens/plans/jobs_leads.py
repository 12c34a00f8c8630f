"""Lead jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.operators import leads as L
from leadlens.operators import reports as R
from leadlens.plans.catalog import entity_as_of, job
from leadlens.sources import adapters as A


def _rollup(t, **filters):
    return L.leads(A.parents(t), A.children(t), A.sessions(t), A.reports(t), entity_as_of(), **filters)


@job("load_entities")
def load_entities(t):
    """Row counts of the five entity views as loaded (one scan each)."""
    parts = [(n, f(t)) for n, f in (("parents", A.parents), ("children", A.children), ("sessions", A.sessions),
                                    ("reports", A.reports), ("messages", A.messages))]
    out = None
    for n, df in parts:
        d = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("entity"), "rows")
        out = d if out is None else out.unionByName(d)
    return out


@job("lead_rollup")
def lead_rollup(t):
    return _rollup(t)


@job("lead_children_label")
def lead_children_label(t):
    return _rollup(t).select("id", "children_label")


@job("lead_filter_status")
def lead_filter_status(t):
    return _rollup(t, status="Yozildi")


@job("lead_filter_grade")
def lead_filter_grade(t):
    return _rollup(t, grade="2")


@job("lead_filter_since")
def lead_filter_since(t):
    return _rollup(t, since_days="30")


@job("leads_filtered")
def leads_filtered(t):
    return _rollup(t, status=" Contacted ", grade="3", since_days="200")


@job("leads_sorted")
def leads_sorted(t):
    return L.leads_sorted(_rollup(t))


@job("lead_rows")
def lead_rows(t):
    return L.lead_rows(_rollup(t))


@job("export_leads_csv")
def export_leads_csv(t):
    return L.csv_file_lines(L.csv_lines(_rollup(t)))


@job("lead_children")
def lead_children(t):
    return L.lead_children_sorted(L.lead_children(A.children(t), A.sessions(t), A.reports(t)))


def _detail(t):
    return L.lead_detail(L.lead_children(A.children(t), A.sessions(t), A.reports(t)))


@job("lead_detail")
def lead_detail(t):
    d = _detail(t)
    return d.select("parent_id", "child_id", "name", "grade",
                    F.size("sessions").cast("long").alias("report_sessions"),
                    F.array_join(F.transform("sessions", lambda s: s["share_token"]), ",").alias("share_tokens"),
                    F.try_element_at("sessions", F.lit(1))["date"].alias("first_date"))


@job("lead_detail_json")
def lead_detail_json(t):
    return L.lead_detail_json(A.parents(t), _detail(t))


@job("report_with_child")
def report_with_child(t):
    r = L.report_with_child(A.reports(t), A.children(t))
    return r.select("session_id", "child_id", "share_token", "nickname", "grade", "level_logic",
                    "level_psych", "level_activity", "partial", "delivered", "created_at")


def _public(t):
    contents = R.parse_report(A.report_replies(t).select("session_id", "raw_text"))
    return L.public_report(L.report_with_child(A.reports(t), A.children(t)), contents)


@job("public_report", spread=True)
def public_report(t):
    return _public(t).select(
        "share_token", "content_md", "nickname", "grade", "partial", "date", F.col("levels.logic").alias("level_logic"),
        F.col("levels.psych").alias("level_psych"), F.col("levels.activity").alias("level_activity"),
        F.array_join("sports", ",").alias("sports"))


@job("public_report_json", spread=True)
def public_report_json(t):
    return L.public_report_json(_public(t))


@job("report_filter_level_sport")
def report_filter_level_sport(t):
    p = L.report_filter_level_sport(A.reports(t), A.children(t), A.parents(t), "kuchli", "Futbol")
    return p.select("id", "name", "lead_status")


@job("lookup_by_token")
def lookup_by_token(t):
    """Requests: every issued share token plus one unknown token per open session."""
    known = A.reports(t).select(F.col("share_token").alias("token"))
    unknown = A.sessions(t).filter(F.col("finished_at").isNull()) \
        .select(F.md5(F.concat(F.lit("missing-"), F.col("id"))).alias("token"))
    rwc = L.report_with_child(A.reports(t), A.children(t))
    return L.lookup_by_token(known.unionByName(unknown), rwc)


@job("lead_status_dim")
def lead_status_dim(t):
    return L.lead_status_dim(A.parents(t))
