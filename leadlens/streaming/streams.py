"""Structured Streaming jobs over a landing folder.

Inputs arrive as files in a landing folder (here Spark stages them from the
driver tables in several slices, so every run takes several micro-batches at
any scale); each job reads it with ``readStream`` and a fixed schema, runs
with ``availableNow`` and a checkpoint under the cluster's
``spark.checkpoint.dir``, and writes an idempotent sink. Re-running a job on
the same checkpoint processes only new files.

Three ways to span micro-batches: ``stream_funnel`` closes event-time windows
by watermark and keeps the rows that come later than it in a side output, so
the two together are exact; ``stream_session_state`` keeps running totals on
the state store and upserts the keys a batch changed; the others keep one
partial aggregate per batch folder and merge them on read. A replayed batch
overwrites its own folders in all of them.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.session import checkpoint_root
from leadlens.sources import keyed


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of one stream job (never reused, never deleted)."""
    return f"{checkpoint_root(spark)}/streams/{name}/{uuid.uuid4().hex}"


#: Slices of a staged landing folder, and so the least number of micro-batches of a run.
SLICES = 4


def stage(df: DataFrame, path: str, fmt: str = "parquet", order: Column | None = None) -> str:
    """Write ``df`` as SLICES landing folders, one after the other (Parquet or JSON lines).

    Slices are shares by a hash of the whole row, so the rows of one key and of
    any period arrive over several micro-batches, out of time order. With
    ``order`` (a column of 0..SLICES-1) they arrive in that order instead. Each
    slice has as many files as ``df`` has partitions.
    """
    share = order if order is not None else F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SLICES))
    for k in range(SLICES):
        df.where(share == k).write.mode("overwrite").format(fmt).save(f"{path}/f{k}")
    return path


def time_slice(df: DataFrame, ts: str) -> Column:
    """Slice (0..SLICES-1) of a row by equal ranges of ``ts`` over the table's whole span; rows without a time are last."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = df.agg(F.min(us), F.max(us)).first()
    if low is None:
        return F.lit(SLICES - 1)
    return F.least(F.floor((us - F.lit(low)) / F.lit((high - low) // SLICES + 1)), F.lit(SLICES - 1))


def run_in_order(df: DataFrame, order: Column, path: str, start) -> None:
    """Land slice after slice of ``order`` (0..SLICES-1) and run the stream on each from its checkpoint.

    Every micro-batch is one whole slice, however many files it has, so no row
    of an earlier slice comes after one of a later slice. ``start(stream)`` runs
    it to the end."""
    for k in range(SLICES):
        df.where(order == k).write.parquet(f"{path}/f{k}")
        start(df.sparkSession.readStream.schema(df.schema).parquet(f"{path}/*"))


def span_seconds(df: DataFrame, ts: str) -> int:
    """Whole seconds between the least and the greatest ``ts``; 0 without any."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = df.agg(F.min(us), F.max(us)).first()
    return 0 if low is None else (high - low) // 1_000_000 + 1


def land_tick(df: DataFrame, ts: str, seconds: int, path: str, start) -> None:
    """Land one row that is null but for a ``ts`` that many seconds after the last one, and run the stream on it: a clock
    tick, with which the watermark passes all rows."""
    tick = df.agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull()).select(*(
        (F.col(ts) + F.make_dt_interval(secs=F.lit(float(seconds)))).cast(f.dataType).alias(f.name) if f.name == ts
        else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
    tick.write.parquet(f"{path}/tick")
    start(df.sparkSession.readStream.schema(df.schema).parquet(f"{path}/*"))


def read_landing(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None,
                 fmt: str = "parquet") -> DataFrame:
    """A file stream over the landing folder with a fixed schema (no inference).

    By default a micro-batch takes one slice's worth of files."""
    if files_per_trigger is None:
        files = len(spark.read.schema(schema).format(fmt).load(f"{path}/*").inputFiles())
        files_per_trigger = max(1, files // SLICES)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .format(fmt).load(f"{path}/*"))


def run_to_sink(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """File sink (exactly-once through its commit log) with availableNow."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()


def run_foreach_batch(stream: DataFrame, fn, checkpoint: str, mode: str = "append") -> None:
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(fn).trigger(availableNow=True).start())
    q.awaitTermination()


def batch_path(root: str, batch_id: int) -> str:
    """One folder per micro-batch, overwritten on replay: idempotent by batch id."""
    return f"{root}/batch_id={batch_id}"


# ---------------------------------------------------------------------------
# Jobs
# ---------------------------------------------------------------------------
def ingest(spark: SparkSession, name: str, source: DataFrame, transform, fmt: str = "parquet") -> DataFrame:
    """Stage -> readStream (Parquet or JSON lines) -> transform -> parquet sink;
    returns the sink as a table. The stream's schema is the source's, fixed."""
    d = run_dir(spark, name)
    stage(source, f"{d}/landing", fmt)
    run_to_sink(transform(read_landing(spark, f"{d}/landing", source.schema, fmt=fmt)), f"{d}/sink", f"{d}/checkpoint")
    return spark.read.parquet(f"{d}/sink")


def ingest_sessions(spark: SparkSession, requests: DataFrame, validate) -> DataFrame:
    """Each micro-batch: validate, then append the children and their sessions
    from the same batch DataFrame, into per-batch folders (a replayed batch
    overwrites its own output, so the two appends stay atomic together)."""
    d = run_dir(spark, "ingest_sessions")
    stage(requests, f"{d}/landing")
    schema = requests.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        ok = validate(batch).filter("valid")
        ok.select(F.col("request_id").alias("id"), "nickname", "grade", "age", "goal", "notes") \
            .write.mode("overwrite").parquet(batch_path(f"{d}/children", batch_id))
        ok.select(F.col("request_id").alias("child_id"),
                  F.md5(F.concat(F.lit("req-"), F.col("request_id").cast("string"))).alias("session_token"),
                  F.lit("active").alias("status")) \
            .write.mode("overwrite").parquet(batch_path(f"{d}/sessions", batch_id))

    run_foreach_batch(read_landing(spark, f"{d}/landing", schema), write, f"{d}/checkpoint")
    kids = spark.read.parquet(f"{d}/children").drop("batch_id")
    sess = spark.read.parquet(f"{d}/sessions").drop("batch_id")
    return kids.join(sess, kids.id == sess.child_id, "inner").drop("child_id")


def first_report_stream(spark: SparkSession, attempts: DataFrame, first_wins) -> DataFrame:
    """Exact first-insert-wins across micro-batches without re-reading the sink.

    Each batch writes, per session, its own first attempt and attempt count;
    the table is the merge of the versions: the earliest attempt (created_at,
    then token) stands whatever batch brought it, attempts add up."""
    v = partials_to_table(spark, "stream_first_report", attempts, first_wins)
    order = F.struct("created_at", "share_token")
    merged = v.groupBy("session_id").agg(F.min(order).alias("w"), F.sum("attempts").alias("attempts"))
    return merged.select("session_id", F.col("w.share_token").alias("share_token"),
                         F.col("w.created_at").alias("created_at"), F.col("attempts").cast("long").alias("attempts"))


def partials_to_table(spark: SparkSession, name: str, source: DataFrame, build,
                      run: str | None = None) -> DataFrame:
    """Each micro-batch writes ``build(batch)`` into its own batch folder;
    returns all of them for the caller to merge by key.

    Writes are O(batch) and a replay overwrites its folder, so every row counts
    exactly once however late it arrives. ``run`` resumes an earlier run folder."""
    d = run or run_dir(spark, name)
    if run is None:
        stage(source, f"{d}/landing")
    out = f"{d}/result"

    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(batch_path(out, batch_id))

    run_foreach_batch(read_landing(spark, f"{d}/landing", source.schema), write, f"{d}/checkpoint")
    return spark.read.parquet(out).drop("batch_id")


def session_state(turns: DataFrame) -> DataFrame:
    """Counters and flags per session (batch or stream)."""
    return turns.groupBy("session_id").agg(
        F.count_if("inc_turn").alias("turns"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.bool_or("m_mantiq").alias("done_mantiq"),
        F.bool_or("m_psixologiya").alias("done_psixologiya"), F.bool_or("m_harakat").alias("done_harakat"))


def session_state_stream(spark: SparkSession, turns: DataFrame, run: str | None = None) -> DataFrame:
    """Running counters per session: a streaming aggregation in update mode, whose totals live in the state store.

    Each micro-batch sends on only the sessions it changed, with their totals, which replace the old rows of the keyed
    table; what a batch reads and writes depends on its own sessions, not on the batches before it. ``run`` resumes a run folder."""
    d = run or run_dir(spark, "stream_session_state")
    if run is None:
        stage(turns, f"{d}/landing")
    totals = session_state(read_landing(spark, f"{d}/landing", turns.schema))
    run_foreach_batch(totals, lambda batch, batch_id: keyed.upsert(batch, "session_id", f"{d}/table", batch_id),
                      f"{d}/checkpoint", "update")
    return keyed.table(spark, f"{d}/table", totals.schema, "session_id")


#: Days of the tumbling windows. Longer ones are whole numbers of the shortest, so a row late for it is late for none before.
FUNNEL_DAYS = (1, 7)


def funnel_counts(events: DataFrame, days: int = 7) -> DataFrame:
    """Epoch-aligned tumbling windows per metric (not the now-anchored weekly funnel); rows without a time are in none."""
    if events.schema["ts"].dataType.simpleString() != "timestamp":  # a cast would hide a stream's watermark
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (events.groupBy(F.window("ts", f"{days} days"), "metric").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window.end").cast("timestamp_ntz").alias("window_end"), "metric", "n"))


def merge_funnel_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("window_start", "window_end", "metric").agg(F.sum("n").alias("n"))


def split_late(spark: SparkSession, d: str, schema, ts: str, lateness: int) -> None:
    """Part the landed rows into ``ontime`` and ``late``, a folder per micro-batch, by the watermark that holds for it:
    the greatest ``ts`` of earlier batches less ``lateness`` seconds. A row is late when the shortest window that it
    belongs to ended by then, which is the rule by which a windowed aggregation drops rows."""
    shortest = min(FUNNEL_DAYS) * 86_400_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))

    def split(batch: DataFrame, batch_id: int) -> None:
        mark = None  # of the batch before this one: one row
        if batch_id:
            mark = spark.read.parquet(batch_path(f"{d}/clock", batch_id - 1)).first().mark
        end = (F.floor(us / F.lit(shortest)) + 1) * F.lit(shortest)
        late = F.lit(False) if mark is None else F.coalesce(end <= F.lit(mark - lateness * 1_000_000), F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(batch_path(f"{d}/ontime", batch_id))
        batch.where(late).write.mode("overwrite").parquet(batch_path(f"{d}/late", batch_id))
        batch.agg(F.greatest(F.max(us), F.lit(mark).cast("long")).alias("mark")).write.mode("overwrite").parquet(
            batch_path(f"{d}/clock", batch_id))

    run_foreach_batch(spark.readStream.schema(schema).parquet(f"{d}/landing/*"), split, f"{d}/split-checkpoint")


def funnel_windows(spark: SparkSession, d: str, schema, lateness: int) -> None:
    """Count the on-time rows by ``withWatermark`` and ``window``, one query per window length, in append mode: a window
    is written once, when the watermark passes its end, and leaves the state."""
    for days in FUNNEL_DAYS:
        events = spark.readStream.schema(schema).parquet(f"{d}/ontime/*").withColumn("ts", F.col("ts").cast("timestamp"))
        run_to_sink(funnel_counts(events.withWatermark("ts", f"{lateness} seconds"), days), f"{d}/windows-{days}",
                    f"{d}/windows-{days}-checkpoint")


def funnel_stream(spark: SparkSession, events: DataFrame, order: Column, lateness: int, run: str | None = None) -> DataFrame:
    """events(metric, ts) -> (window_start, window_end, metric, n) for daily and 7-day windows, exact whatever comes late.

    Slice after slice (``order``) lands; each time the split and then the counts run from their checkpoints, so each
    micro-batch of the counts takes whole batches of the split and both see the same watermark. A clock tick closes the
    last windows. The result is the closed windows plus the counts of the late rows."""
    d = run or run_dir(spark, "stream_funnel")

    def start(_stream: DataFrame) -> None:
        split_late(spark, d, events.schema, "ts", lateness)
        funnel_windows(spark, d, events.schema, lateness)

    run_in_order(events, order, f"{d}/landing", start)
    land_tick(events, "ts", lateness + 2 * 86_400 * max(FUNNEL_DAYS), f"{d}/landing", start)
    return funnel_table(spark, d, events.schema)


WINDOWS_SCHEMA = "window_start timestamp_ntz, window_end timestamp_ntz, metric string, n long"


def funnel_table(spark: SparkSession, d: str, schema) -> DataFrame:
    """Closed windows and late rows of a run folder, merged."""
    late = spark.read.schema(schema).parquet(f"{d}/late/*")
    parts = [spark.read.schema(WINDOWS_SCHEMA).parquet(f"{d}/windows-{days}").unionByName(funnel_counts(late, days))
             for days in FUNNEL_DAYS]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return merge_funnel_counts(both)
