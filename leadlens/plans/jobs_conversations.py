"""Conversation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.operators import conversations as C
from leadlens.plans.catalog import job
from leadlens.sources import adapters as A

# Short stand-in for the system prompt (its wording is not part of this engine).
SYSTEM_PROMPT = "Siz bolalar qobiliyatini baholovchi yordamchisiz."


@job("transcript_order")
def transcript_order(t):
    return C.transcript_order(A.messages(t))


@job("visible_transcript")
def visible_transcript(t):
    return C.visible_transcript(A.messages(t))


@job("merge_turns")
def merge_turns(t):
    return C.merge_turns(A.messages(t))


@job("openai_turns")
def openai_turns(t):
    return C.openai_turns(A.messages(t), SYSTEM_PROMPT)


@job("last_turn")
def last_turn(t):
    return C.last_turn(A.messages(t))


@job("dangling_user_turn")
def dangling_user_turn(t):
    return C.dangling_user_turn(A.messages(t))


@job("turn_cap")
def turn_cap(t):
    # Forty conversations make a session, so that sessions pass the product's cap of 60 turns.
    return C.turn_cap(A.messages(t).withColumn("session_id", F.floor(F.col("session_id") / 40)))


@job("engagement_gate")
def engagement_gate(t):
    return C.engagement_gate(A.session_messages(t), A.sessions(t))


@job("track_markers")
def track_markers(t):
    return C.track_markers(A.messages(t))


@job("progress_from_messages")
def progress_from_messages(t):
    return C.progress_from_messages(A.messages(t))


@job("session_progress")
def session_progress(t):
    return C.session_progress(A.sessions(t))


@job("session_counters")
def session_counters(t):
    return C.session_counters(A.messages(t))


@job("grade_band")
def grade_band(t):
    return C.grade_bands(A.children(t))


@job("minimized_llm_view")
def minimized_llm_view(t):
    return C.minimized_llm_view(A.children(t))


@job("resume_json")
def resume_json(t):
    return C.resume_documents(A.sessions(t), A.children(t), A.session_messages(t), A.reports(t))
