"""Sliding-log admission limiter (per key): batch and streaming forms.

Semantics: per key, entries with ts <= now - window have expired; a hit is
refused when ``max`` entries are live, and refused hits are not recorded.
A decision depends on earlier decisions, so no window aggregate expresses
it (a RANGE count over all hits over-refuses).

Batch: rows are range-partitioned on (key, ts, id) and sorted, so a key holding
a third of all rows is spread over many partitions, idle gaps or not. A
partition's rows of one key are a chunk. Decisions of a chunk depend on earlier
chunks only through the log they leave, at most ``max`` timestamps. All chunks
that a key continues through are decided from an assumed incoming log first;
then only chunks whose incoming log turned out different are decided again,
until none does: a fixed point, and so the sequential result. Different logs
soon admit the same hits, so few chunks are redone.

Stream: a state machine (``transformWithStateInPandas``) on the state store, one
for each of ``BUCKETS`` hash buckets of keys, as each call to the store and each
timer costs a round trip, which one machine per key would pay for every key and
slot. Hits wait in the state, grouped by slots of event time, until the
watermark passes their slot; a timer then decides them in time order against
the logs of their keys. Decisions equal the batch form however late a hit
arrives within ``lateness``; a later hit is refused and marked late. Logs expire
by event time.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from leadlens.plans.sequence import PID, lay_out

# The functions below run in Python workers. Ship them by value so workers
# need only pandas, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _decide(rows: pd.DataFrame, logs: dict) -> list[bool]:
    out = []
    for key, t, w, m in zip(rows["key"].to_numpy(), rows["ts_us"].to_numpy(), rows["window_us"].to_numpy(),
                            rows["max_hits"].to_numpy()):
        log = logs.get(key)
        if log is None:
            log = logs[key] = deque()
        cutoff = t - w
        while log and log[0] <= cutoff:
            log.popleft()
        if len(log) < m:
            log.append(t)
            out.append(True)
        else:
            out.append(False)
    return out


def _walk(batches: Iterator[pd.DataFrame], incoming: dict[int, tuple[str, list[int]]]
          ) -> Iterator[tuple[pd.DataFrame, list[bool], int, dict]]:
    """(rows, decisions, partition, open logs) of the sorted batches of a task, which may hold several partitions."""
    logs, at = {}, None
    for b in batches:
        for pid, rows in b.groupby(PID, sort=False):
            if pid != at:
                at, logs = pid, {}
                if pid in incoming:
                    key, log = incoming[pid]
                    logs[key] = deque(log)
            decided = _decide(rows, logs)
            # Rows are sorted by key: only the last one can go on.
            last = rows["key"].iloc[-1]
            logs = {last: logs[last]}
            yield rows, decided, int(pid), logs


def _open_chunks(laid: DataFrame) -> tuple[dict[int, str], dict[int, int]]:
    """Keys that partitions hand on to the next one with rows: ({pid: key handed on}, {pid: the one before it}).

    One row per partition reaches the driver."""
    ends = laid.groupBy(PID).agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy(PID).collect()
    handed, before = {}, {}
    for a, b in zip(ends, ends[1:]):
        if a["last"] == b["first"]:
            handed[a[PID]] = a["last"]
            before[b[PID]] = a[PID]
    return handed, before


def incoming_logs(laid: DataFrame) -> dict[int, tuple[str, list[int]]]:
    """{partition: (its first key, the log that earlier partitions leave for it)}, for keys that go on into it.

    Rounds: decide the chunks that hand a key on, from the logs assumed so far, and redo those whose own incoming log
    changed. At most one log of ``max`` entries per partition is held."""
    handed, before = _open_chunks(laid)
    spark = laid.sparkSession
    after: dict[int, list[int]] = {}
    incoming: dict[int, tuple[str, list[int]]] = {}
    todo = set(handed)
    while todo:
        now = dict(incoming)

        def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ends: dict[int, list[int]] = {}
            for _, _, pid, logs in _walk(batches, now):
                ends[pid] = list(next(iter(logs.values())))
            yield pd.DataFrame({PID: pd.Series(list(ends), dtype="int32"), "log": pd.Series(list(ends.values()), dtype=object)})

        wanted = F.broadcast(spark.createDataFrame([(p, handed[p]) for p in sorted(todo)], f"{PID} int, key string"))
        chunk = laid.select("key", "id", "ts_us", "window_us", "max_hits", PID).join(wanted, [PID, "key"], "left_semi")
        for r in chunk.mapInPandas(tails, f"{PID} int, log array<long>").collect():
            after[r[PID]] = list(r["log"])
        found = {p: (handed[q], after[q]) for p, q in before.items() if after[q]}
        # A chunk's own log can only change when its partition is one chunk: another key would begin afresh.
        todo = {p for p in handed if p in before and handed[p] == handed[before[p]] and found.get(p) != incoming.get(p)}
        incoming = found
    return incoming


def admission_limit(hits: DataFrame, window_seconds: int | None = None, max_hits: int | None = None,
                    partitions: int | None = None) -> DataFrame:
    """hits(key string, id long, ts timestamp[, window_us long, max_hits int][, route]) ->
    ([route,] key, id, ts, admitted). A constant window/max may be given instead of columns. Hits without a key have
    no limit and are admitted."""
    h = hits
    if window_seconds is not None:
        h = h.withColumn("window_us", F.lit(int(window_seconds) * 1_000_000).cast("long"))
    if max_hits is not None:
        h = h.withColumn("max_hits", F.lit(int(max_hits)).cast("int"))
    h = h.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"),
                 F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "window_us", "max_hits",
                 (F.col("route") if "route" in hits.columns else F.lit(None).cast("string")).alias("route"))
    free = h.where(F.col("key").isNull()).select("key", "id", "ts_us", F.lit(True).alias("admitted"), "route")
    laid = lay_out(h.where(F.col("key").isNotNull()), "key", ["ts_us", "id"], partitions)
    incoming = incoming_logs(laid)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, decided, _, _ in _walk(batches, incoming):
            yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "ts_us": rows["ts_us"],
                                "admitted": pd.Series(decided, index=rows.index), "route": rows["route"]})

    decided = laid.mapInPandas(decide, "key string, id long, ts_us long, admitted boolean, route string").unionByName(free)
    return decided.select(*(["route"] if "route" in hits.columns else []), "key", "id",
                          F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"), "admitted")


# ---------------------------------------------------------------------------
# Streaming form
# ---------------------------------------------------------------------------
STREAM_OUT = "key string, id long, ts_us long, admitted boolean, late boolean"
#: Spark's state store with timers and list state.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of keys. Fixed for a checkpoint, as state is held by bucket; a bucket's state is that of its keys.
BUCKETS = 512


class SlidingLog(StatefulProcessor):
    """State of a bucket of keys: ``pending`` hits by slot of event time, and the ``log`` of admitted times by key."""

    def __init__(self, window_us: int, max_hits: int, slot_ms: int):
        self.window_us, self.max_hits, self.slot_ms = window_us, max_hits, slot_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "slot_end_ms long", "keys array<string>, times array<long>, ids array<long>")
        self.log = handle.getValueState("log", "keys array<string>, times array<long>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for hits in rows:
            hits = hits[hits["is_hit"]]  # the others only move the clock
            slot_end = (hits["ts_us"] // 1000 // self.slot_ms + 1) * self.slot_ms
            late = slot_end <= mark  # its slot has been decided
            if late.any():
                yield hits.loc[late, ["key", "id", "ts_us"]].assign(admitted=False, late=True)
            for end, own in hits[~late].groupby(slot_end[~late]):
                end = int(end)
                keys, times, ids = self.pending.getValue((end,)) if self.pending.containsKey((end,)) else ([], [], [])
                self.pending.updateValue((end,), ([*keys, *own["key"]], [*times, *own["ts_us"].tolist()], [*ids, *own["id"].tolist()]))
                self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = int(expiredTimerInfo.getExpiryTimeInMs())
        logs: dict[str, deque] = {}
        if self.log.exists():
            for k, t in zip(*self.log.get()):
                logs.setdefault(k, deque()).append(t)
        rows = None
        if self.pending.containsKey((due,)):
            keys, times, ids = self.pending.getValue((due,))
            self.pending.removeKey((due,))
            # The hits of one slot of one bucket, no more than arrived for it.
            rows = pd.DataFrame({"key": pd.Series(list(keys), dtype=object), "id": list(ids), "ts_us": list(times)}) \
                .sort_values(["ts_us", "id"])
            rows["admitted"] = _decide(rows.assign(window_us=self.window_us, max_hits=self.max_hits), logs)
        # Slots are decided in order, so hits yet to come are no earlier than the end of this one.
        live = [(k, int(t)) for k, log in logs.items() for t in log if t + self.window_us > due * 1000]
        if live:
            self.log.update(([k for k, _ in live], [t for _, t in live]))
            # Past this time the last entry has expired, unless a later slot has added one.
            last = max(t for _, t in live)
            self.handle.registerTimer((last + self.window_us) // 1000 // self.slot_ms * self.slot_ms + self.slot_ms + 1)
        elif logs:
            self.log.clear()
        if rows is not None:
            yield rows.assign(late=False)


def admission_limit_stream(hits: DataFrame, window_seconds: int, max_hits: int, lateness: str = "0 seconds",
                           slot_seconds: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Streaming hits -> decisions (key, id, ts_us, admitted, late), each once the watermark passes the hit's slot.

    ``lateness`` is how much event time a hit may come after later ones; ``slot_seconds`` (default: the window) is how
    finely decisions follow the watermark. A row without an id is a clock tick: it moves the watermark and has no
    decision. The watermark column does not reach the operator, so Spark drops no late row before it can be marked."""
    h = hits.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"),
                    F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                    F.col("ts").cast("timestamp").alias("clock")).withWatermark("clock", lateness)
    zero = F.lit(0).cast("long")  # pandas holds longs with nulls among them as floats
    h = h.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", F.coalesce("id", zero).alias("id"),
                 F.coalesce("ts_us", zero).alias("ts_us"), (F.col("id").isNotNull() & F.col("ts_us").isNotNull()).alias("is_hit"))
    machine = SlidingLog(int(window_seconds) * 1_000_000, int(max_hits), int(slot_seconds or window_seconds) * 1000)
    return h.groupBy("bucket").transformWithStateInPandas(machine, STREAM_OUT, "append", "EventTime")


def with_state_store(spark: SparkSession, run) -> None:
    """``run()`` with queries on the RocksDB state store, which list state and timers need; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        run()
    finally:
        spark.conf.set(name, before)


# Route policies (key prefix, window in seconds, most hits). Message and report calls are counted per
# session, the others per address.
POLICIES = [
    ("new_session", "newsess:", 24 * 60 * 60, 5),
    ("message", "msg:", 60, 20),
    ("report", "report:", 30, 2),
    ("read", "report:", 60, 120),
    ("admin_login", "adminlogin:", 60, 5),
    ("webhook", "tgwebhook:", 60, 120),
]


def policy_table(spark) -> DataFrame:
    """The route policies: a fixed six-row dimension (safe to broadcast)."""
    return spark.createDataFrame([(r, p, w * 1_000_000, m) for r, p, w, m in POLICIES],
                                 "route string, prefix string, window_us long, max_hits int")


def limit_policies(requests: DataFrame) -> DataFrame:
    """requests(route, caller, id, ts) -> per-route decisions, keyed prefix || caller.

    A route without a policy, or a request without a caller, has no limit: it is admitted, with a NULL key."""
    pol = F.broadcast(policy_table(requests.sparkSession))
    h = requests.join(pol, "route", "left").select(
        "route", F.concat(F.col("prefix"), F.col("caller").cast("string")).alias("key"), "id", "ts",
        F.coalesce("window_us", F.lit(0).cast("long")).alias("window_us"), F.coalesce("max_hits", F.lit(0)).alias("max_hits"))
    return admission_limit(h)
