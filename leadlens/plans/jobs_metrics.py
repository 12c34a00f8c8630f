"""Metric jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.operators import metrics as M
from leadlens.plans.catalog import entity_as_of, events_as_of, job
from leadlens.sources import adapters as A


@job("weekly_funnel")
def weekly_funnel(t):
    """Four now-anchored 7-day buckets over the event stream."""
    return M.weekly_funnel(A.funnel_events(t), events_as_of())


@job("weekly_funnel_entities")
def weekly_funnel_entities(t):
    """Same buckets over sessions/parents/reports, each with its own clock."""
    return M.weekly_funnel_entities(A.sessions(t), A.parents(t), A.reports(t), entity_as_of())


@job("funnel_conversion")
def funnel_conversion(t):
    return M.funnel_conversion(M.weekly_funnel(A.funnel_events(t), events_as_of()))


@job("token_totals")
def token_totals(t):
    return M.token_totals(A.sessions(t))


@job("cost_estimate")
def cost_estimate(t):
    return M.cost_estimate(M.token_totals(A.sessions(t)))


@job("ops_finished_per_day")
def ops_finished_per_day(t):
    return M.ops_finished_per_day(A.sessions(t))


@job("ops_avg_tokens")
def ops_avg_tokens(t):
    return M.ops_avg_tokens(A.sessions(t))


@job("ops_delivery_rate")
def ops_delivery_rate(t):
    return M.ops_delivery_rate(A.reports(t))


@job("by_prompt_version_model")
def by_prompt_version_model(t):
    return M.by_prompt_version_model(A.sessions(t), A.reports(t))


@job("token_outliers")
def token_outliers(t):
    # Token counts are near-uniform in the fixtures; about one session in a hundred used forty times as many.
    heavy = F.when(F.col("child_id") % 97 == 0, F.col("input_tokens") * 40).otherwise(F.col("input_tokens"))
    return M.token_outliers(A.sessions(t).withColumn("input_tokens", heavy))


@job("level_mix")
def level_mix(t):
    return M.level_mix(A.reports(t))


@job("sport_counts")
def sport_counts(t):
    return M.sport_counts(A.reports(t))
