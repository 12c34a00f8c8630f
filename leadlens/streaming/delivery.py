"""Delivery webhook: parse bot updates, match tokens to reports.

The same functions serve batch and streaming DataFrames: parsing is a
projection, matching a left join of updates with reports. As streams the two
are joined on the token within bounds of event time, with watermarks on both
sides, so the state holds no more than the bounds ask for and the reports table
is not read again for each micro-batch. What finds no report in time is written
to its own sink and looked up once more, exactly, at the end of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.functions.exprs import js_trim
from leadlens.sources import keyed
from leadlens.streaming import streams as S

UPDATE_SCHEMA = "update_id long, message struct<chat: struct<id: long>, text: string, date: long>"
START_RE = r"^/start\s+(\S+)"


def parse_updates(updates: DataFrame, col: str = "update_json") -> DataFrame:
    """JSON update text -> (update_id, chat_id, text, token, ts); token NULL
    when the text is not '/start <token>'."""
    u = updates.select(F.from_json(F.col(col), UPDATE_SCHEMA).alias("u"))
    # A missing text gives a NULL token (the update is ignored downstream); no
    # separate filter, so the parse is not repeated in a pushed-down predicate.
    tok = F.regexp_extract(js_trim(F.col("u.message.text")), START_RE, 1)
    return u.select(
        F.col("u.update_id").alias("update_id"), F.col("u.message.chat.id").alias("chat_id"),
        F.col("u.message.text").alias("text"),
        F.when(tok == "", F.lit(None).cast("string")).otherwise(tok).alias("token"),
        F.timestamp_seconds(F.col("u.message.date")).cast("timestamp_ntz").alias("ts"))


def match_updates(parsed: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched): tokens found in reports vs. 'not found' replies.
    Updates without a token get the help reply and change nothing."""
    r = reports.select(F.col("share_token").alias("r_token"), "session_id")
    with_tok = parsed.filter(F.col("token").isNotNull())
    j = with_tok.join(r, with_tok.token == r.r_token, "left")
    matched = j.filter(F.col("r_token").isNotNull()).select("update_id", "chat_id", "token", "session_id", "ts")
    unmatched = j.filter(F.col("r_token").isNull()).select("update_id", "chat_id", "token", "ts")
    return matched, unmatched


#: A report is matched when it was written up to REPORT_AGE before its update, or up to REPORT_DELAY after it.
REPORT_AGE, REPORT_DELAY = "30 days", "1 hour"


def join_streams(updates: DataFrame, reports: DataFrame, lateness: str, age: str = REPORT_AGE,
                 delay: str = REPORT_DELAY) -> DataFrame:
    """Streams parsed updates(update_id, chat_id, token, ts) left outer join reports(share_token, session_id, created_at).

    A match is sent on at once, whichever side lands first; an update without one when the watermark, the lesser of both
    sides', has passed its bounds. ``lateness`` is how far rows of either stream may be out of order."""
    u = updates.withColumn("u_ts", F.col("ts").cast("timestamp")).withWatermark("u_ts", lateness)
    r = reports.select(F.col("share_token").alias("r_token"), F.col("session_id").alias("r_session"),
                       F.col("created_at").cast("timestamp").alias("r_ts")).withWatermark("r_ts", lateness)
    near = F.expr(f"r_token = token AND r_ts >= u_ts - INTERVAL {age} AND r_ts <= u_ts + INTERVAL {delay}")
    return u.join(r, near, "left_outer").select(
        "update_id", "chat_id", "token", F.col("r_session").alias("session_id"), F.col("r_token").isNotNull().alias("found"), "ts")


def _earliest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("token").agg(F.min("ts").alias("ts"))


OUTCOME_SCHEMA = "update_id long, chat_id long, token string, session_id string, found boolean, ts timestamp_ntz"


def _parsed_landing(spark: SparkSession, d: str, schema) -> DataFrame:
    return parse_updates(spark.readStream.schema(schema).parquet(f"{d}/updates/*")).select("update_id", "chat_id", "token", "ts")


def reply_streams(spark: SparkSession, d: str, updates_schema) -> None:
    """One run, from its checkpoint, over the landed updates that no join can hold for: those without a token go to
    ``help``, those without a time to ``undated``. No state."""

    def replies(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumns({"session_id": F.lit(None).cast("string"), "found": F.lit(False)}).select(
            "update_id", "chat_id", "token", "session_id", "found", "ts")
        batch.where("token is null and update_id is not null").write.mode("overwrite").parquet(
            S.batch_path(f"{d}/help", batch_id))
        batch.where("token is not null").write.mode("overwrite").parquet(S.batch_path(f"{d}/undated", batch_id))

    S.run_foreach_batch(_parsed_landing(spark, d, updates_schema).where("token is null or ts is null"), replies,
                        f"{d}/replies-checkpoint")


def match_streams(spark: SparkSession, d: str, updates_schema, reports_schema, lateness: str, last: bool = True) -> None:
    """One run of the join over the landed updates and reports of a run folder, from its checkpoint. A run that is not the
    ``last`` leaves it to the next one's first batch to send on what the watermark has passed since, instead of going
    through the whole state once more for that.

    Per micro-batch: updates with and without a report each in their own sink (``outcomes``, by ``found``), and the
    first delivery time per token in the keyed table ``delivered``."""
    parsed = _parsed_landing(spark, d, updates_schema)
    reports = spark.readStream.schema(reports_schema).parquet(f"{d}/reports/*")

    def outcomes(batch: DataFrame, batch_id: int) -> None:
        at = S.batch_path(f"{d}/outcomes", batch_id)
        batch.write.mode("overwrite").partitionBy("found").parquet(at)  # once: the join's state is not worked on twice
        held = spark.read.schema(OUTCOME_SCHEMA).parquet(at)
        keyed.upsert(_earliest(held.where("found")), "token", f"{d}/delivered", batch_id, merge=_earliest)

    with S.settings(spark, {"spark.sql.streaming.noDataMicroBatches.enabled": str(last).lower()}):
        S.run_foreach_batch(join_streams(parsed.where("token is not null and ts is not null"), reports, lateness),
                            outcomes, f"{d}/join-checkpoint")


def outcomes(spark: SparkSession, d: str, reports: DataFrame, joined_too: bool = True) -> DataFrame:
    """All updates (without ``joined_too``: all but those that the streams matched) of a run folder with their outcome: help, not found or delivered. Updates that the streams could not
    match, as the report is older than the bound or the update has no time, are looked up in the reports once."""
    def sink(name: str) -> DataFrame:
        return spark.read.schema(OUTCOME_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{d}/{name}")

    joined = spark.read.schema(OUTCOME_SCHEMA + ", batch_id long").parquet(f"{d}/outcomes").drop("batch_id")
    left = joined.where("not found").unionByName(sink("undated")).drop("session_id", "found")
    known = reports.select(F.col("share_token").alias("r_token"), F.col("session_id"))
    late = left.join(known, left.token == known.r_token, "left").select(
        "update_id", "chat_id", "token", "session_id", F.col("r_token").isNotNull().alias("found"), "ts")
    kind = F.when(F.col("token").isNull(), "help").when(F.col("found"), "delivered").otherwise("not found")
    rest = late.unionByName(sink("help"))
    return (joined.where("found").unionByName(rest) if joined_too else rest).withColumn("outcome", kind)


def first_deliveries(spark: SparkSession, d: str, reports: DataFrame) -> DataFrame:
    """(token, ts): the first delivery per token. Matched updates come from the keyed table, which each batch kept up to
    date; of the others only those that the lookup finds are grouped."""
    kept = keyed.table(spark, f"{d}/delivered", "token string, ts timestamp_ntz", "token", _earliest)
    late = outcomes(spark, d, reports, joined_too=False).where("found").select("token", "ts")
    return _earliest(kept.unionByName(late))


def staged_reports(spark: SparkSession, d: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{d}/staged/reports")


def run_matching(spark: SparkSession, name: str, updates: DataFrame, reports: DataFrame) -> str:
    """Land updates and reports in slices of time, every tenth report a slice after its time, and run the streams after
    each slice; clock ticks on both sides end the run. Returns the run folder.

    Both tables are written once (``staged_reports``) and the slices and their bounds taken from there, so the tables are
    not built anew for each of them."""
    d = S.run_dir(spark, name)
    when = F.timestamp_seconds(F.get_json_object("update_json", "$.message.date").cast("long")).cast("timestamp_ntz")
    timed = updates.withColumn("ts", when)
    timed.write.parquet(f"{d}/staged/updates")
    reports.write.parquet(f"{d}/staged/reports")
    timed = spark.read.schema(timed.schema).parquet(f"{d}/staged/updates")
    reports = staged_reports(spark, d, reports.schema)
    u_slice = S.time_slice(timed, "ts")
    delayed = F.when(F.pmod(F.xxhash64("share_token"), F.lit(10)) == 0, 1).otherwise(0)
    r_slice = F.least(S.time_slice(reports, "created_at") + delayed, F.lit(S.SLICES - 1))
    span = max(S.span_seconds(timed, "ts"), S.span_seconds(reports, "created_at"))
    lateness = f"{2 * (span // S.SLICES + 1)} seconds"

    def run(last: bool = False) -> None:
        match_streams(spark, d, updates.schema, reports.schema, lateness, last)

    for k in range(S.SLICES):
        timed.where(u_slice == k).drop("ts").write.parquet(f"{d}/updates/f{k}")
        reports.where(r_slice == k).write.parquet(f"{d}/reports/f{k}")
        run()
    # A message of no update, and a report of no session, far ahead of both streams: clock ticks. Both carry a token, as
    # rows without one can't match and Spark drops them before they move the watermark.
    ahead = 3 * span + 90 * 86_400
    text = F.format_string('{"message": {"text": "/start -", "date": %d}}',
                           F.coalesce(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))), F.lit(0)) + F.lit(ahead))
    timed.agg(text.alias("update_json")).write.parquet(f"{d}/updates/tick")
    at = (F.coalesce(F.max("created_at"), F.lit("1970-01-01").cast("timestamp_ntz")) + F.make_dt_interval(secs=F.lit(float(ahead))))
    reports.agg(at.alias("created_at")).select(*(
        F.col(f.name) if f.name == "created_at" else F.lit("--" if f.name == "share_token" else None).cast(f.dataType).alias(f.name)
        for f in reports.schema)) \
        .write.parquet(f"{d}/reports/tick")
    run(last=True)
    reply_streams(spark, d, updates.schema)
    return d
