"""Funnel, cost and operations metrics.

All are one-pass aggregations: partial aggregation runs map-side, so the
shuffle carries one row per (task, group), not per input row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions.exprs import (PRICE_IN_PER_MTOK, PRICE_OUT_PER_MTOK, WEEK_MICROS,
                                      micros, round_half_up)

FUNNEL_METRICS = ["started", "finished", "contact", "delivered"]
N_WEEKS = 4


def weekly_buckets(metric_ts: DataFrame, as_of: Column, weeks: int = N_WEEKS) -> DataFrame:
    """(metric, ts) rows -> one row per rolling 7-day bucket anchored at ``as_of``.

    bucket = floor((as_of - ts) / 7 days); rows older than 28 days (inclusive
    bound, whose bucket is 4) and future rows fall outside [0, weeks) and are
    dropped; missing buckets are zero-filled.
    """
    lower = F.timestamp_add("DAY", F.lit(-7 * weeks), as_of)
    wk = F.floor((micros(as_of) - micros(F.col("ts"))) / F.lit(WEEK_MICROS)).cast("long")
    counted = (metric_ts
               .filter(F.col("ts").isNotNull() & (F.col("ts") >= lower))
               .select("metric", wk.alias("wk"))
               .filter((F.col("wk") >= 0) & (F.col("wk") < weeks))
               .groupBy("wk")
               .agg(*[F.count_if(F.col("metric") == m).alias(m) for m in FUNNEL_METRICS]))
    spine = metric_ts.sparkSession.range(weeks).select(F.col("id").alias("wk"))
    # ``counted`` has at most ``weeks`` rows: the join is bounded by construction.
    return (spine.join(F.broadcast(counted), "wk", "left")
            .select("wk", *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in FUNNEL_METRICS]))


def weekly_funnel(funnel_events: DataFrame, as_of: Column) -> DataFrame:
    """Event stream with a ``metric`` column already mapped."""
    return weekly_buckets(funnel_events.select("metric", "ts"), as_of)


def funnel_entity_events(sessions: DataFrame, parents: DataFrame, reports: DataFrame) -> DataFrame:
    """The four clocks: session start, session finish, parent consent, first delivery."""
    return (sessions.select(F.lit("started").alias("metric"), F.col("started_at").alias("ts"))
            .unionByName(sessions.select(F.lit("finished").alias("metric"), F.col("finished_at").alias("ts")))
            .unionByName(parents.select(F.lit("contact").alias("metric"), F.col("consented_at").alias("ts")))
            .unionByName(reports.select(F.lit("delivered").alias("metric"), F.col("delivered_at").alias("ts"))))


def weekly_funnel_entities(sessions: DataFrame, parents: DataFrame, reports: DataFrame,
                           as_of: Column) -> DataFrame:
    return weekly_buckets(funnel_entity_events(sessions, parents, reports), as_of)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def funnel_conversion(buckets: DataFrame) -> DataFrame:
    """Step ratios per week; NULL where the denominator is zero."""
    return buckets.select(
        "wk", *FUNNEL_METRICS,
        _ratio(F.col("finished"), F.col("started")).alias("finish_rate"),
        _ratio(F.col("contact"), F.col("finished")).alias("contact_rate"),
        _ratio(F.col("delivered"), F.col("contact")).alias("delivery_rate"),
    )


def token_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("finished_at").isNotNull()).alias("finished"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
    )


def cost_estimate(totals: DataFrame, price_in: float = PRICE_IN_PER_MTOK,
                  price_out: float = PRICE_OUT_PER_MTOK) -> DataFrame:
    """USD estimate rounded half-up to cents; per-finished from the unrounded cost."""
    raw = (F.col("input_tokens") / F.lit(1e6) * F.lit(price_in)
           + F.col("output_tokens") / F.lit(1e6) * F.lit(price_out))
    return totals.select(
        "sessions", "finished", "input_tokens", "output_tokens",
        round_half_up(raw).alias("est_usd"),
        F.when(F.col("finished") > 0, round_half_up(raw / F.col("finished"))).alias("per_finished_usd"),
    )


def ops_finished_per_day(sessions: DataFrame) -> DataFrame:
    return (sessions.filter(F.col("finished_at").isNotNull())
            .groupBy(F.to_date("finished_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("finished")))


def exact_avg(c: str) -> Column:
    """sum/count with an exact integer sum: independent of partitioning order."""
    return F.sum(c).cast("double") / F.count(c).cast("double")


def ops_avg_tokens(sessions: DataFrame) -> DataFrame:
    s = sessions.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return s.groupBy("model").agg(
        F.count(F.lit(1)).alias("sessions"),
        exact_avg("input_tokens").alias("avg_input_tokens"),
        exact_avg("output_tokens").alias("avg_output_tokens"),
        exact_avg("total_tokens").alias("avg_total_tokens"),
    )


def ops_delivery_rate(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count(F.lit(1)).alias("reports"),
        F.count_if(F.col("delivered")).alias("delivered"),
        _ratio(F.count_if(F.col("delivered")), F.count(F.lit(1))).alias("delivery_rate"),
    )


def by_prompt_version_model(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """A/B view: sessions, finish rate, tokens and logic-level mix per (prompt_version, model).

    Reports are reduced to (session_id, level_logic) before the join so the
    shuffle carries two columns; the join is 1:1 on session id.
    """
    r = reports.select(F.col("session_id").alias("id"), "level_logic")
    j = sessions.select("id", "prompt_version", "model", "finished_at", "input_tokens", "output_tokens") \
        .join(r, "id", "left")
    n = F.count(F.lit(1))
    fin = F.count_if(F.col("finished_at").isNotNull())
    return j.groupBy("prompt_version", "model").agg(
        n.alias("sessions"),
        fin.alias("finished"),
        _ratio(fin, n).alias("finish_rate"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.count("level_logic").alias("reports_with_logic"),
        F.count_if(F.col("level_logic") == "kuchli").alias("logic_kuchli"),
        F.count_if(F.col("level_logic") == "meyorda").alias("logic_meyorda"),
        F.count_if(F.col("level_logic") == "shakllanmoqda").alias("logic_shakllanmoqda"),
    )


def token_outliers(sessions: DataFrame, k: float = 3.0) -> DataFrame:
    """Sessions whose total tokens exceed mean + k * stddev_pop of their model.

    Per-model statistics are a grouped aggregate joined back by broadcast: one
    row of three values per model name. A join by model would send all sessions
    of a model to one task; no single-partition window.
    """
    s = sessions.select("id", "model", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    stats = s.groupBy("model").agg(
        (F.sum("tokens").cast("double") / F.count("tokens")).alias("mean_tokens"),
        F.stddev_pop("tokens").alias("sd_tokens"))
    return (s.join(F.broadcast(stats), "model")
            .filter(F.col("tokens") > F.col("mean_tokens") + F.lit(k) * F.col("sd_tokens"))
            .select("id", "model", "tokens"))


def level_mix(reports: DataFrame) -> DataFrame:
    """Level distribution per track (unpivot of the three level columns)."""
    long = reports.select(F.expr(
        "stack(3, 'mantiq', level_logic, 'psixologiya', level_psych, 'harakat', level_activity) "
        "as (track, level)"))
    return (long.filter(F.col("level").isNotNull())
            .groupBy("track", "level").agg(F.count(F.lit(1)).alias("reports")))


def sport_counts(reports: DataFrame) -> DataFrame:
    return (reports.select(F.explode("sports").alias("sport"))
            .groupBy("sport").agg(F.count(F.lit(1)).alias("reports")))
