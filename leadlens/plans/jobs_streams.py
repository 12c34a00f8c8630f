"""Stream and limiter jobs."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from leadlens.operators import governance as G
from leadlens.operators import identity as I
from leadlens.operators import reports as R
from leadlens.plans.catalog import job
from leadlens.sources import adapters as A
from leadlens.streaming import delivery as D
from leadlens.streaming import limiter as L
from leadlens.streaming import streams as S


@job("admission_limit")
def admission_limit(t):
    """Events per user, 1-day window, at most 3 admitted."""
    hits = t.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts")
    return L.admission_limit(hits, window_seconds=24 * 3600, max_hits=3)


@job("limit_policies")
def limit_policies(t):
    """Each event type is a route with its own policy; the caller is a session or an address of the user.

    A tenth of the views are webhook calls, another tenth a route without a policy."""
    et, tenth = F.col("event_type"), F.col("user_id") % 10
    route = (F.when(et == "signup", "new_session").when(et == "click", "message").when(et == "purchase", "report")
             .when(et == "error", "admin_login").when(tenth == 0, "webhook").when(tenth == 1, "health")
             .otherwise("read"))
    caller = F.concat(F.when(et.isin("click", "purchase"), "s").otherwise("ip"), F.col("user_id").cast("string"))
    req = t.events.select(route.alias("route"), caller.alias("caller"), F.col("event_id").alias("id"), "ts")
    return L.limit_policies(req)


@job("stream_admission_limit")
def stream_admission_limit(t):
    """The admission limiter as a stream. Hits land in slices of time, a tenth of them a slice late; the stream stops
    and restarts after each. Lateness covers two slices, so no hit is refused as late; a clock tick ends the run."""
    hits = t.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts")
    d = S.run_dir(t.spark, "stream_admission_limit")
    delayed = (F.pmod(F.xxhash64("id"), F.lit(10)) == 0).cast("long")
    slices = F.least(S.time_slice(hits, "ts") + delayed, F.lit(S.SLICES - 1))
    window, span = 24 * 3600, S.span_seconds(hits, "ts")
    lateness = 2 * (span // S.SLICES + 1)

    def start(stream):
        S.run_to_sink(L.admission_limit_stream(stream, window, 3, f"{lateness} seconds"), f"{d}/sink", f"{d}/checkpoint")

    def run():
        S.run_in_order(hits, slices, f"{d}/landing", start)
        S.land_tick(hits, "ts", lateness + 3 * window, f"{d}/landing", start)

    L.with_state_store(t.spark, run)
    return t.spark.read.schema(L.STREAM_OUT).parquet(f"{d}/sink").select(
        "key", "id", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"), "admitted")


@job("ingest_messages")
def ingest_messages(t):
    return S.ingest(t.spark, "ingest_messages", t.conversations,
                    lambda s: A.messages(SimpleNamespace(conversations=s)))


@job("ingest_sessions")
def ingest_sessions(t):
    return S.ingest_sessions(t.spark, A.session_requests(t), G.dq_session_requests)


@job("ingest_delivery_updates", spread=True)
def ingest_delivery_updates(t):
    return S.ingest(t.spark, "ingest_delivery_updates", A.delivery_updates(t),
                    lambda s: D.parse_updates(s).select("update_id", "chat_id", "token", "ts"))


def _matched(t, name):
    """(run folder, reports) of updates and reports joined as streams."""
    reports = A.reports(t).select("share_token", "session_id", "created_at")
    d = D.run_matching(t.spark, name, A.delivery_updates(t), reports)
    return d, D.staged_reports(t.spark, d, reports.schema)


@job("webhook_match", spread=True)
def webhook_match(t):
    """/start tokens with their reports, joined as two streams; unknown -> found=false."""
    d, reports = _matched(t, "webhook_match")
    return D.outcomes(t.spark, d, reports).where("token is not null and update_id is not null").select(
        "update_id", "token", "found", "session_id", "ts")


@job("delivery_replies", spread=True)
def delivery_replies(t):
    """What the bot answers to each update: help without a token, not found, or the delivered report."""
    d, reports = _matched(t, "delivery_replies")
    return D.outcomes(t.spark, d, reports).where("update_id is not null").select(
        "update_id", "chat_id", "token", "outcome", "session_id", "ts")


@job("stream_first_report")
def stream_first_report(t):
    return S.first_report_stream(t.spark, A.report_attempts(t), R.first_report_wins)


@job("stream_delivery", spread=True)
def stream_delivery(t):
    """Delivery times from the joined streams: the keyed first times, and those of updates that only the lookup found."""
    d, reports = _matched(t, "stream_delivery")
    first = D.first_deliveries(t.spark, d, reports)
    return I.mark_delivered(A.reports(t), first.select("token", "ts"))


@job("stream_session_state")
def stream_session_state(t):
    """Running counters per session from the turn log."""
    return S.session_state_stream(t.spark, A.turn_log(t))


@job("stream_funnel")
def stream_funnel(t):
    """Daily and 7-day windows. Events land in slices of time; a tenth come one slice late, a tenth up to three, the
    watermark allows one, so part of them reach the late output."""
    events = A.funnel_events(t)
    tenth = F.pmod(F.xxhash64("metric", "ts"), F.lit(10))
    slices = F.least(S.time_slice(events, "ts") + F.when(tenth == 0, 1).when(tenth == 1, 3).otherwise(0), F.lit(S.SLICES - 1))
    return S.funnel_stream(t.spark, events, slices, S.span_seconds(events, "ts") // S.SLICES + 1)
