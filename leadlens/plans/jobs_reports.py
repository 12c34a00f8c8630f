"""Report jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.operators import conversations as C
from leadlens.operators import reports as R
from leadlens.plans.catalog import entity_as_of, job
from leadlens.sources import adapters as A


def _parsed(t):
    return R.parse_report(A.report_replies(t).select("session_id", "child_id", "partial", "raw_text"))


@job("parse_report", spread=True)
def parse_report(t):
    return _parsed(t).select("session_id", "content_md", "level_logic", "level_psych", "level_activity",
                             F.array_join("sports", ",").alias("sports"),
                             F.size("sports").cast("long").alias("n_sports"))


@job("report_sections", spread=True)
def report_sections(t):
    return R.report_sections(_parsed(t))


@job("report_bullets", spread=True)
def report_bullets(t):
    return R.report_bullets(R.report_sections(_parsed(t)))


@job("child_facing_cards")
def child_facing_cards(t):
    return R.child_facing_cards(A.messages(t))


@job("adult_text")
def adult_text(t):
    return R.adult_text(A.messages(t))


@job("greeting_audit")
def greeting_audit(t):
    """The first reply of every session: long enough, with a card, no track reported as done."""
    return R.greeting_audit(A.messages(t))


@job("report_quality_audit", spread=True)
def report_quality_audit(t):
    return R.report_quality_audit(_parsed(t))


@job("premature_markers")
def premature_markers(t):
    # In every fifth session the child never answers.
    m = A.messages(t).filter((F.col("role") != "user") | (F.col("session_id") % 5 != 0))
    return R.premature_markers(C.progress_from_messages(m), C.engagement_gate(m))


@job("first_report_wins")
def first_report_wins(t):
    return R.first_report_wins(A.report_attempts(t))


@job("progress_timeline")
def progress_timeline(t):
    return R.progress_timeline(A.reports(t))


@job("reassessment_due")
def reassessment_due(t):
    return R.reassessment_due(A.parents(t), A.children(t), A.sessions(t), entity_as_of(), months=3)
