"""Conversation processing over the message log.

Ordered per-session logic (positions, role islands, running counts) goes
through ``leadlens.plans.sequence``: rows are range-partitioned on
(session, created_at, id), so even a session holding a third of the log is
spread over many tasks, and cross-partition carries are a broadcast table of
at most one row per partition. There is never an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Documents keep null members, as JSON.stringify does (Spark drops them by default).
JSON_OPTS = {"ignoreNullFields": "false"}

from leadlens.functions.exprs import (CAP_REPLY, MAX_TURNS, MIN_ANSWERS_FOR_REPORT, TRACKS, grade_band,
                                      has_marker)
from leadlens.plans.sequence import lay_out, sequence

ORDER = ["created_at", "id"]


def chat_role(role: Column) -> Column:
    """Any role other than assistant is sent as user."""
    return F.when(role == "assistant", F.lit("assistant")).otherwise(F.lit("user"))


def transcript_order(messages: DataFrame) -> DataFrame:
    """Position of each message in its session: created_at, then id."""
    m = lay_out(messages.select("session_id", "id", "role", "meta", "created_at"), "session_id", ORDER)
    return sequence(m, "session_id", ORDER).select("session_id", "id", "role", "meta", "created_at",
                                                   F.col("_rn").cast("long").alias("pos"))


def visible_transcript(messages: DataFrame) -> DataFrame:
    """What the adult sees: meta turns (intro, report request) hidden."""
    return messages.filter(~F.col("meta")).select("session_id", "id", "role", "content", "created_at")


def merge_turns(messages: DataFrame) -> DataFrame:
    """Alternating user/assistant turns for the messages API.

    Roles collapse to user/assistant, NULL content -> '', runs of one role are
    joined with a blank line, then a leading assistant run is dropped.
    Gaps-and-islands: an island starts where the role changes.
    """
    m = messages.select("session_id", "id", "created_at", chat_role(F.col("role")).alias("role"),
                        F.coalesce(F.col("content"), F.lit("")).alias("content"))
    laid = lay_out(m, "session_id", ORDER)
    m = sequence(laid, "session_id", ORDER, prev_cols=["role"]).drop("_rn")
    m = m.withColumn("start", (F.col("_prev_role").isNull() | (F.col("_prev_role") != F.col("role"))).cast("long"))
    m = sequence(m.drop("_prev_role"), "session_id", ORDER, sums={"start": F.col("start")})
    m = m.withColumn("island", F.col("_before_start") + F.col("start"))
    merged = (m.groupBy("session_id", "island")
              .agg(F.first("role").alias("role"),
                   F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))).alias("parts")))
    merged = merged.filter(~((F.col("island") == 1) & (F.col("role") == "assistant")))
    return merged.select("session_id", F.col("island").cast("long").alias("turn"), "role",
                         F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("content"))


def openai_turns(messages: DataFrame, system_prompt: str | None) -> DataFrame:
    """Chat-completions shape: no merging, empty content dropped, system row first."""
    m = messages.select("session_id", "id", "created_at", chat_role(F.col("role")).alias("role"),
                        F.coalesce(F.col("content"), F.lit("")).alias("content"))
    laid = lay_out(m.filter(F.col("content") != ""), "session_id", ORDER)
    body = sequence(laid, "session_id", ORDER).select("session_id", "role", "content",
                                                      F.col("_rn").cast("long").alias("pos"))
    if not system_prompt:
        return body
    sys_rows = (messages.select("session_id").distinct()
                .select("session_id", F.lit("system").alias("role"), F.lit(system_prompt).alias("content"),
                        F.lit(0).cast("long").alias("pos")))
    return sys_rows.unionByName(body)


def last_turn(messages: DataFrame) -> DataFrame:
    """Last message per session (by created_at, id) via max_by — no window, no sort."""
    key = F.struct("created_at", "id")
    return messages.groupBy("session_id").agg(
        F.max_by("id", key).alias("last_id"),
        F.max_by("role", key).alias("last_role"),
        F.max_by("meta", key).alias("last_meta"))


def dangling_user_turn(messages: DataFrame) -> DataFrame:
    """pending: last turn is not an assistant reply (a retry re-generates);
    needs_report_request: the report request is appended unless the last turn
    already is a meta user turn."""
    lt = last_turn(messages)
    is_user = chat_role(F.col("last_role")) == "user"
    return lt.select("session_id", "last_id", "last_role",
                     is_user.alias("pending"),
                     (~(is_user & F.col("last_meta"))).alias("needs_report_request"))


def llm_turn(role, content):
    """An assistant message that is a real model reply (not the cap notice)."""
    return (role == "assistant") & (F.coalesce(content, F.lit("")) != F.lit(CAP_REPLY))


def turn_cap(messages: DataFrame, cap: int = MAX_TURNS) -> DataFrame:
    """LLM turns taken before each message; a user message at or over the cap
    is stored but gets no LLM turn (the cap notice is not a turn)."""
    laid = lay_out(messages.select("session_id", "id", "created_at", "role", "content"), "session_id", ORDER)
    s = sequence(laid, "session_id", ORDER, sums={"llm": llm_turn(F.col("role"), F.col("content")).cast("long")})
    before = F.col("_before_llm").cast("long")
    return s.select("session_id", "id", "role", before.alias("turns_before"),
                    ((F.col("role") != "assistant") & (before >= cap)).alias("over_cap"))


def engagement_gate(messages: DataFrame, sessions: DataFrame | None = None,
                    min_answers: int = MIN_ANSWERS_FOR_REPORT) -> DataFrame:
    """Real answers = user turns that are not meta; markers never count.

    With ``sessions`` given, sessions without messages are kept with 0.
    """
    need = max(1, int(min_answers))
    answers = messages.groupBy("session_id").agg(
        F.count_if((F.col("role") == "user") & ~F.col("meta")).alias("real_answers"))
    if sessions is not None:
        answers = sessions.select(F.col("id").alias("session_id")).join(answers, "session_id", "left")
    real = F.coalesce(F.col("real_answers"), F.lit(0)).cast("long")
    return answers.select("session_id", real.alias("real_answers"), (real >= need).alias("gate_ok"))


def track_markers(messages: DataFrame) -> DataFrame:
    """Completion flags found in each assistant reply."""
    a = messages.filter(F.col("role") == "assistant")
    return a.select("session_id", "id", *[has_marker(F.col("content"), t).alias("m_" + t.lower()) for t in TRACKS])


def progress_from_messages(messages: DataFrame) -> DataFrame:
    """Monotone OR of the markers over a session's assistant replies."""
    tm = track_markers(messages)
    g = tm.groupBy("session_id").agg(*[F.bool_or("m_" + t.lower()).alias("done_" + t.lower()) for t in TRACKS])
    return g.withColumn("all_done", F.col("done_mantiq") & F.col("done_psixologiya") & F.col("done_harakat"))


def session_progress(sessions: DataFrame) -> DataFrame:
    done = F.col("done_mantiq") & F.col("done_psixologiya") & F.col("done_harakat")
    return sessions.select("id", "done_mantiq", "done_psixologiya", "done_harakat",
                           done.alias("done"), (~done).alias("partial"))


def session_counters(messages: DataFrame) -> DataFrame:
    """Counters folded from the log: LLM turns (assistant replies, not the cap
    notice), real answers, meta turns, characters exchanged, first/last activity."""
    return messages.groupBy("session_id").agg(
        F.count_if(llm_turn(F.col("role"), F.col("content"))).alias("turn_count"),
        F.count_if((F.col("role") == "user") & ~F.col("meta")).alias("answers"),
        F.count_if(F.col("meta")).alias("meta_turns"),
        F.sum(F.length(F.coalesce("content", F.lit("")))).cast("long").alias("chars"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"))


# The first (meta) user turn sent to the model. Only nickname,
# grade, band and age leave our store.
INTRO_HEAD = ("Assalomu alaykum! Yangi mashg'ulotni boshlaymiz. Men bolaning yonidagi katta odamman "
              "(ota-ona yoki o'qituvchi).\nBola haqida:\n- Ismi: ")
INTRO_GRADE = "\n- Sinfi: "
INTRO_BAND = "-sinf ("
INTRO_BAND_END = " guruh savollari)"
INTRO_AGE = "\n- Yoshi: "
INTRO_TAIL = ("\nMeni qisqa kutib oling, bolaning ismi va sinfini tasdiqlang va darhol birinchi savollar "
              "guruhini bering. Bolaning maqsadi yoki orzusini suhbat davomida o'zimizdan so'rang.")


def minimized_llm_view(children: DataFrame) -> DataFrame:
    """Allow-list projection of what may be sent to the model, plus the intro text."""
    band = grade_band(F.col("grade"))
    age_line = F.when(F.coalesce(F.col("age"), F.lit(0)) != 0,
                      F.concat(F.lit(INTRO_AGE), F.col("age").cast("string"))).otherwise(F.lit(""))
    intro = F.concat(F.lit(INTRO_HEAD), F.col("nickname"), F.lit(INTRO_GRADE), F.col("grade").cast("string"),
                     F.lit(INTRO_BAND), band, F.lit(INTRO_BAND_END), age_line, F.lit(INTRO_TAIL))
    return children.select(F.col("id").alias("child_id"), "nickname", "grade", "age",
                           band.alias("band"), intro.alias("intro"))


def grade_bands(children: DataFrame) -> DataFrame:
    return children.select("id", "grade", grade_band(F.col("grade")).alias("band"))


def resume_documents(sessions: DataFrame, children: DataFrame, messages: DataFrame,
                     reports: DataFrame) -> DataFrame:
    """One resume document per session: child, ordered messages, progress,
    done, turn_count and the report link (or null). Messages are grouped per
    session before the join (a transcript is bounded by the turn cap)."""
    msgs = (messages.groupBy(F.col("session_id").cast("string").alias("m_sid"))
            .agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content", "meta"))).alias("m")))
    c = children.select(F.col("id").alias("c_id"), "nickname", "grade", "age", "goal", "notes")
    r = reports.select(F.col("session_id").alias("r_sid"), "share_token", "partial")
    j = (sessions.join(c, sessions.child_id == c.c_id, "left")
         .join(r, sessions.id == r.r_sid, "left")
         .join(msgs, sessions.id == msgs.m_sid, "left"))
    done = F.col("done_mantiq") & F.col("done_psixologiya") & F.col("done_harakat")
    doc = F.struct(
        F.struct("nickname", "grade", "age", "goal", "notes").alias("child"),
        F.transform(F.coalesce("m", F.array()), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"),
                                                                   x["meta"].alias("meta"))).alias("messages"),
        F.col("status"),
        F.struct(F.col("done_mantiq").alias("mantiq"), F.col("done_psixologiya").alias("psixologiya"),
                 F.col("done_harakat").alias("harakat")).alias("progress"),
        done.alias("done"), F.col("turn_count"),
        F.when(F.col("share_token").isNotNull(),
               F.struct(F.col("share_token"), F.col("partial"))).alias("report"))
    return j.select(F.col("id").alias("session_id"), F.to_json(doc, JSON_OPTS).alias("doc"))
