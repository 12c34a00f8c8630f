import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from leadlens.plans import jobs_streams
from leadlens.streaming import limiter as L
from leadlens.streaming import streams as S
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def hits(spark, pairs):
    return spark.createDataFrame([(k, i, T0 + timedelta(seconds=s)) for i, (k, s) in enumerate(pairs)],
                                 "key string, id long, ts timestamp_ntz")


def decisions(df):
    return [r[0] for r in rows(df.orderBy("id"), "admitted")]


def test_reference_sequence(spark):
    h = hits(spark, [("a", s) for s in [1, 2, 3, 61, 62, 63]])
    assert decisions(L.admission_limit(h, 60, 2)) == [True, True, False, True, True, False]


def test_equal_timestamps_and_keys(spark):
    h = hits(spark, [("a", 5), ("a", 5), ("a", 5), ("b", 5), ("a", 65), ("b", 6)])
    assert decisions(L.admission_limit(h, 60, 2)) == [True, True, False, True, True, True]


def brute(pairs, window, mx):
    logs, out = {}, {}
    for i, (k, s) in sorted(enumerate(pairs), key=lambda x: (x[1][0], x[1][1], x[0])):
        lg = [t for t in logs.get(k, []) if t > s - window]
        out[i] = len(lg) < mx
        if out[i]:
            lg.append(s)
        logs[k] = lg
    return [out[i] for i in range(len(pairs))]


def test_against_brute_force_and_invariant(spark):
    import random
    rnd = random.Random(7)
    pairs = [(rnd.choice("abc"), rnd.randint(0, 600)) for _ in range(400)]
    got = decisions(L.admission_limit(hits(spark, pairs), 60, 3, partitions=3))
    assert got == brute(pairs, 60, 3)
    for k in "abc":
        adm = sorted(s for (kk, s), ok in zip(pairs, got) if ok and kk == k)
        assert all(sum(1 for t in adm if s - 60 < t <= s) <= 3 for s in adm)


def test_events_counts(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    h = ev.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts")
    c = dict(rows(L.admission_limit(h, 86400, 3).groupBy("admitted").count()))
    assert c == {True: 7567, False: 2433}


def stream(spark, d, slices, lateness, restart=True, tick=10**7):
    """Land slice after slice and run the stream on each from its checkpoint; a clock tick ends the run."""
    schema = "key string, id long, ts timestamp_ntz"
    end = spark.createDataFrame([(None, None, T0 + timedelta(seconds=tick))], schema)

    def run():
        for k, part in enumerate([*slices, end]):
            part.write.parquet(f"{d}/landing/f{k}")
            S.run_to_sink(L.admission_limit_stream(spark.readStream.schema(schema).parquet(f"{d}/landing/*"), 60, 3, lateness),
                          f"{d}/out", f"{d}/ck")
    L.with_state_store(spark, run)
    return {r.id: (r.admitted, r.late) for r in spark.read.parquet(f"{d}/out").collect()}


def test_stream_equals_batch_with_restarts_and_delayed_hits(spark):
    """Hits of four restarted runs come up to 200 seconds late, over three windows."""
    rnd = random.Random(2)
    pairs = [("k%d" % (i % 4), rnd.randint(0, 800)) for i in range(300)]
    h = hits(spark, pairs)
    arrives = F.least(F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(int(T0.timestamp()))
                               + F.pmod(F.hash("id"), F.lit(200))) / 250), F.lit(3))
    slices = [h.where(arrives == k) for k in range(4)]
    assert all(p.count() for p in slices)
    got = stream(spark, S.run_dir(spark, "limiter_test"), slices, "200 seconds")
    assert [got[i] for i in range(300)] == [(ok, False) for ok in brute(pairs, 60, 3)]


def test_stream_marks_hits_that_come_too_late(spark):
    early, late = hits(spark, [("a", 0), ("a", 1000), ("b", 1001)]), hits(spark, [("a", 5)] * 2 + [("b", 1)])
    late = late.withColumn("id", F.col("id") + 10)
    after = hits(spark, [("a", 1002), ("a", 1003), ("a", 1004)]).withColumn("id", F.col("id") + 20)
    got = stream(spark, S.run_dir(spark, "late_test"), [early, early.limit(0), late, after], "30 seconds")
    assert {i for i, (_, is_late) in got.items() if is_late} == {10, 11, 12}
    assert not any(ok for ok, is_late in got.values() if is_late)
    assert [got[i][0] for i in (0, 1, 2, 20, 21, 22)] == [True, True, True, True, True, False]


def test_stream_plan_uses_the_state_store(spark):
    d = S.run_dir(spark, "plan_test")
    hits(spark, [("a", 1)]).write.parquet(f"{d}/landing/f0")
    plans = []

    def run():
        out = L.admission_limit_stream(spark.readStream.schema("key string, id long, ts timestamp_ntz").parquet(f"{d}/landing/*"), 60, 3)
        q = (out.writeStream.format("noop").option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
        plans.append(q._jsq.explainInternal(True))

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    L.with_state_store(spark, run)
    assert "StateStoreSave" in plans[0] or "TransformWithState" in plans[0]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


@pytest.mark.parametrize("gap", [1, 7, 30])
def test_hot_key_without_idle_gaps_is_decided_in_parallel(spark, gap):
    """60 % of rows in one key without an idle gap: its chunks lie in many partitions, none reads much more than its share."""
    rnd = random.Random(gap)
    pairs = [("hot", i * gap // 2 + rnd.randint(0, gap)) for i in range(600)] + [(f"c{i % 90}", rnd.randint(0, 900)) for i in range(400)]
    h = hits(spark, pairs).repartition(3)
    assert decisions(L.admission_limit(h, 60, 3, partitions=10)) == brute(pairs, 60, 3)
    laid = L.lay_out(h.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp"))), "key", ["ts_us", "id"], 10)
    per = [r["count"] for r in laid.where("key = 'hot'").groupBy(L.PID).count().collect()]
    assert len(per) >= 5 and max(per) <= 200


def test_chunks_are_redone_until_logs_agree(spark):
    """A strictly periodic key never forgets its phase: every chunk's log differs from the assumed one."""
    pairs = [("p", 10 * i) for i in range(300)] + [("q", 7 * i) for i in range(60)]
    assert decisions(L.admission_limit(hits(spark, pairs), 95, 4, partitions=12)) == brute(pairs, 95, 4)


def test_empty_hits_and_hits_without_a_key(spark):
    assert L.admission_limit(hits(spark, []), 60, 3).count() == 0
    h = spark.createDataFrame([(None, i, T0) for i in range(5)] + [("a", 5 + i, T0) for i in range(5)],
                              "key string, id long, ts timestamp_ntz")
    assert decisions(L.admission_limit(h, 60, 3)) == [True] * 5 + [True] * 3 + [False] * 2


def test_policies_admit_unknown_routes_and_keep_the_route(spark):
    req = spark.createDataFrame(
        [(r, c, i, T0 + timedelta(seconds=s)) for i, (r, c, s) in enumerate(
            [("report", "s1", 1), ("report", "s1", 2), ("report", "s1", 3), ("read", "ip1", 3), ("health", "ip1", 3),
             ("health", "ip1", 4), ("read", None, 5), ("webhook", "ip1", 6)] + [("admin_login", "ip1", 10)] * 6)],
        "route string, caller string, id long, ts timestamp_ntz")
    got = {r.id: r for r in L.limit_policies(req).collect()}
    assert len(got) == 14
    assert [got[i].admitted for i in range(14)] == [True, True, False, True, True, True, True, True] + [True] * 5 + [False]
    assert [got[i].key for i in (0, 3, 4, 6, 7, 8)] == ["report:s1", "report:ip1", None, None, "tgwebhook:ip1", "adminlogin:ip1"]
    assert got[0].route == "report" and got[3].route == "read"


def test_stream_job_over_two_months_equals_batch(spark):
    rnd = random.Random(3)
    rows_ = [(i % 3, i, T0 + timedelta(seconds=rnd.randint(0, 60 * 86400))) for i in range(600)] + [(7, 600, T0), (7, 601, T0)]
    events = spark.createDataFrame(rows_, "user_id long, event_id long, ts timestamp_ntz").repartition(3)
    got = {r.id: r.admitted for r in jobs_streams.stream_admission_limit(SimpleNamespace(spark=spark, events=events)).collect()}
    h = events.selectExpr("cast(user_id as string) as key", "event_id as id", "ts")
    assert got == {r.id: r.admitted for r in L.admission_limit(h, 86400, 3).collect()} and len(got) == 602


def test_stream_job_takes_whole_slices_of_unequal_files(spark):
    rnd = random.Random(9)
    early = spark.createDataFrame([(1, i, T0 + timedelta(seconds=rnd.randint(0, 8 * 86400))) for i in range(40)],
                                  "user_id long, event_id long, ts timestamp_ntz").coalesce(1)
    late = spark.createDataFrame([(1, 40 + i, T0 + timedelta(days=20, seconds=rnd.randint(0, 86400 * 9))) for i in range(200)],
                                 early.schema).repartition(5)
    events = early.union(late)
    got = {r.id: r.admitted for r in jobs_streams.stream_admission_limit(SimpleNamespace(spark=spark, events=events)).collect()}
    h = events.selectExpr("cast(user_id as string) as key", "event_id as id", "ts")
    assert got == {r.id: r.admitted for r in L.admission_limit(h, 86400, 3).collect()} and len(got) == 240


def test_stream_state_is_held_by_bucket(spark):
    """The store holds no entry and no timer per key, only a few per bucket of keys."""
    d = S.run_dir(spark, "bucket_test")
    schema = "key string, id long, ts timestamp_ntz"
    hits(spark, [(f"k{i}", i % 50) for i in range(4000)]).write.parquet(f"{d}/landing/f0")
    held = []

    def run():
        out = L.admission_limit_stream(spark.readStream.schema(schema).parquet(f"{d}/landing/*"), 60, 3)
        q = out.writeStream.format("noop").option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        held.extend(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])

    L.with_state_store(spark, run)
    assert 0 < max(held) <= 4 * L.BUCKETS


def test_stream_keeps_large_ids_beside_clock_ticks(spark):
    """A tick without an id in the same bucket and batch must not turn ids into floats."""
    big = 2 ** 53 + 1
    h = spark.createDataFrame([(None, big, T0), (None, None, T0), (None, big + 2, T0 + timedelta(seconds=1))], "key string, id long, ts timestamp_ntz")
    got = stream(spark, S.run_dir(spark, "large_id_test"), [h], "0 seconds")
    assert set(got) == {big, big + 2} and all(ok for ok, _ in got.values())
