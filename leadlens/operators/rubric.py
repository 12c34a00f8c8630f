"""Rubric rules over an answer log: RIASEC lean, logic level, track coverage.

answers(session_id, track, kind, riasec_letter, correct, ts). Everything is
a per-session aggregation; the only window ranks at most six letters per
session after aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# RIASEC letters in their conventional order (also the tie-break).
RIASEC = "RIASEC"
# [design] thresholds: a "clear lean" needs 2+ answers for a letter; "almost all"
# correct means 90%.
MIN_LEAN = 2
KUCHLI_SHARE = 0.9
# Minimum evidence per track.
COVERAGE = {"logic_tasks": 5, "logic_kinds": 3, "riasec": 3, "growth": 2, "self_control": 1, "feelings": 1,
            "preference": 2, "mini_task": 2}


def riasec_top2(answers: DataFrame) -> DataFrame:
    """The one or two most repeated letters per session (ties: RIASEC order)."""
    c = (answers.filter(F.col("riasec_letter").isNotNull())
         .groupBy("session_id", "riasec_letter").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("session_id").orderBy(F.col("n").desc(), F.instr(F.lit(RIASEC), F.col("riasec_letter")))
    return (c.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter((F.col("rank") <= 2) & (F.col("n") >= MIN_LEAN))
            .select("session_id", F.col("riasec_letter").alias("letter"), "n", "rank"))


def logic_level(answers: DataFrame) -> DataFrame:
    """Share of correct logic tasks -> shakllanmoqda (< 1/2), kuchli (>= 0.9), else meyorda."""
    a = answers.filter(F.col("track") == "mantiq")
    g = a.groupBy("session_id").agg(F.count(F.lit(1)).alias("tasks"), F.count_if("correct").alias("correct"))
    share = F.col("correct") / F.col("tasks")
    return g.select("session_id", "tasks", "correct",
                    F.when(share < 0.5, "shakllanmoqda").when(share >= KUCHLI_SHARE, "kuchli")
                     .otherwise("meyorda").alias("level"))


def track_coverage(answers: DataFrame) -> DataFrame:
    """Minimum evidence per track and overall."""
    k, t = F.col("kind"), F.col("track")
    g = answers.groupBy("session_id").agg(
        F.count_if(t == "mantiq").alias("logic_tasks"),
        F.count_distinct(F.when(t == "mantiq", k)).alias("logic_kinds"),
        F.count_if((t == "mantiq") & (k == "language")).alias("language"),
        F.count_if(k == "riasec").alias("riasec"), F.count_if(k == "growth").alias("growth"),
        F.count_if(k == "self_control").alias("self_control"), F.count_if(k == "feelings").alias("feelings"),
        F.count_if(k == "preference").alias("preference"), F.count_if(k == "mini_task").alias("mini_task"))
    c = COVERAGE
    logic = (F.col("logic_tasks") >= c["logic_tasks"]) & (F.col("logic_kinds") >= c["logic_kinds"]) & (F.col("language") >= 1)
    psych = ((F.col("riasec") >= c["riasec"]) & (F.col("growth") >= c["growth"])
             & (F.col("self_control") >= c["self_control"]) & (F.col("feelings") >= c["feelings"]))
    move = (F.col("preference") >= c["preference"]) & (F.col("mini_task") >= c["mini_task"])
    return g.select("session_id", "logic_tasks", "logic_kinds", logic.alias("mantiq_ok"), psych.alias("psixologiya_ok"),
                    move.alias("harakat_ok"), (logic & psych & move).alias("all_ok"))
