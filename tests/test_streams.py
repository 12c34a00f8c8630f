import os
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from leadlens.operators.reports import first_report_wins
from leadlens.sources import keyed
from leadlens.streaming import delivery as D
from leadlens.streaming import streams as S
from tests.conftest import rows

SCHEMA = "session_id string, share_token string, created_at timestamp_ntz"


def test_file_sink_restart_is_exactly_once(spark):
    d = S.run_dir(spark, "restart_test")
    src = spark.createDataFrame([(i, f"m{i}") for i in range(20)], "id long, text string")
    for part in range(2):
        src.filter(F.col("id") % 2 == part).write.parquet(f"{d}/landing/p{part}")
        stream = spark.readStream.schema("id long, text string").parquet(f"{d}/landing/*")
        S.run_to_sink(stream.withColumn("n", F.length("text")), f"{d}/sink", f"{d}/ck")
    # A third run with no new files adds nothing.
    S.run_to_sink(spark.readStream.schema("id long, text string").parquet(f"{d}/landing/*")
                  .withColumn("n", F.length("text")), f"{d}/sink", f"{d}/ck")
    got = sorted(r[0] for r in rows(spark.read.parquet(f"{d}/sink"), "id"))
    assert got == list(range(20))


def test_first_report_stream_equals_batch(spark):
    t0 = datetime(2024, 1, 1)
    att = spark.createDataFrame(
        [(f"s{i % 7}", f"t{i}", t0 + timedelta(seconds=(i * 37) % 50)) for i in range(60)], SCHEMA)
    got = S.first_report_stream(spark, att, first_report_wins)
    exp = first_report_wins(att)
    assert sorted(rows(got, "session_id", "share_token", "attempts")) == sorted(
        rows(exp, "session_id", "share_token", "attempts"))


def batches(folder):
    return len([f for f in os.listdir(f"{folder}/checkpoint/commits") if not f.startswith(".")])


def test_staging_gives_several_batches_with_a_keys_rows_apart(spark):
    d = S.run_dir(spark, "staging_test")
    src = spark.range(200).select(F.lit("one").alias("session_id"), "id")
    S.stage(src, f"{d}/landing")
    parts = [spark.read.parquet(f"{d}/landing/f{k}") for k in range(S.SLICES)]
    assert S.SLICES >= 4 and all(p.count() for p in parts) and sum(p.count() for p in parts) == 200
    spans = [p.agg(F.min("id"), F.max("id")).first() for p in parts]
    assert all(a[0] < b[1] and b[0] < a[1] for a in spans for b in spans)  # periods overlap: out of order
    S.run_to_sink(S.read_landing(spark, f"{d}/landing", src.schema), f"{d}/sink", f"{d}/checkpoint")
    assert batches(d) >= 4 and spark.read.parquet(f"{d}/sink").count() == 200


def funnel_events(spark, n=300):
    return spark.range(n).select(
        (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(F.col("id").cast("int") % 90)).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 2 == 0, "started").otherwise("finished").alias("metric"))


def batch_windows(events):
    return sorted(tuple(r) for days in S.FUNNEL_DAYS for r in S.funnel_counts(events, days).collect())


def test_funnel_windows_and_late_rows_equal_batch_over_restarts(spark):
    """Slices by hash arrive wholly out of time order, so most rows of the later ones are late."""
    events = funnel_events(spark)
    d = S.run_dir(spark, "funnel_test")
    share = F.pmod(F.xxhash64("ts", "metric"), F.lit(S.SLICES))
    got = S.funnel_stream(spark, events, share, 10 * 86400, run=d)
    assert sorted(map(tuple, got.collect())) == batch_windows(events)
    late = spark.read.schema(events.schema).parquet(f"{d}/late/*").count()
    assert 0 < late < 300
    for name in ("split-checkpoint", "windows-1-checkpoint", "windows-7-checkpoint"):
        assert len([f for f in os.listdir(f"{d}/{name}/commits") if not f.startswith(".")]) >= 4
    # A run without new files changes nothing, and no window is written twice.
    S.split_late(spark, d, events.schema, "ts", 10 * 86400)
    S.funnel_windows(spark, d, events.schema, 10 * 86400)
    assert sorted(map(tuple, S.funnel_table(spark, d, events.schema).collect())) == batch_windows(events)
    for days in S.FUNNEL_DAYS:
        closed = spark.read.schema(S.WINDOWS_SCHEMA).parquet(f"{d}/windows-{days}")
        assert closed.count() == closed.select("window_start", "metric").distinct().count()


def test_funnel_in_time_order_has_no_late_row(spark):
    events = funnel_events(spark, 200)
    d = S.run_dir(spark, "funnel_order_test")
    got = S.funnel_stream(spark, events, S.time_slice(events, "ts"), 0, run=d)
    assert sorted(map(tuple, got.collect())) == batch_windows(events)
    assert spark.read.schema(events.schema).parquet(f"{d}/late/*").count() == 0


def turns(spark, n=80, sessions=3):
    return spark.range(n).select((F.col("id") % sessions).alias("session_id"), (F.col("id") % 4 == 0).alias("inc_turn"),
                                 F.col("id").alias("input_tokens"), F.lit(2).alias("output_tokens"),
                                 (F.col("id") == 30).alias("m_mantiq"), F.lit(False).alias("m_psixologiya"),
                                 (F.col("id") > 70).alias("m_harakat"))


def test_session_state_sums_a_session_over_batches_and_restart(spark):
    d = S.run_dir(spark, "state_test")
    all_turns = turns(spark)
    S.stage(all_turns.where("input_tokens < 60"), f"{d}/landing")
    S.session_state_stream(spark, all_turns, run=d)
    all_turns.where("input_tokens >= 60").write.parquet(f"{d}/landing/later")
    got = S.session_state_stream(spark, all_turns, run=d)
    assert batches(d) >= 5
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.session_state(all_turns).collect()))


def test_upsert_rewrites_touched_buckets_and_replays(spark):
    root = S.run_dir(spark, "keyed_test")
    schema = "k long, v string"
    frame = lambda *r: spark.createDataFrame(list(r), schema)
    keyed.upsert(frame(*((i, "a") for i in range(100)), (None, "a")), "k", root, 0, buckets=8)
    keyed.upsert(frame((5, "b"), (200, "b")), "k", root, 1, buckets=8)
    keyed.upsert(frame(), "k", root, 2, buckets=8)
    keyed.upsert(frame((7, "c"), (None, "c")), "k", root, 3, buckets=8)
    want = {**{i: "a" for i in range(100)}, 5: "b", 200: "b", 7: "c", None: "c"}
    assert dict(map(tuple, keyed.table(spark, root, schema).collect())) == want
    assert len(os.listdir(f"{root}/data/v=1")) <= 2 + len([f for f in os.listdir(f"{root}/data/v=1") if "bucket" not in f])
    keyed.upsert(frame((7, "c"), (None, "c")), "k", root, 3, buckets=8)  # replayed after a failure
    rows_ = keyed.table(spark, root, schema).collect()
    assert dict(map(tuple, rows_)) == want and len(rows_) == len(want)


def test_session_batches_read_their_own_buckets(spark):
    """The buckets read by a batch of one session don't grow with the number of batches before it."""
    root = S.run_dir(spark, "keyed_growth_test")
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v long")
    keyed.upsert(frame(*((i, 0) for i in range(400))), "k", root, 0, buckets=8)
    for b in range(1, 6):
        keyed.upsert(frame((1, b)), "k", root, b, buckets=8)
        rewritten = spark.read.parquet(f"{root}/data/v={b}").count()
        assert rewritten < 100
    assert keyed.table(spark, root, "k long, v long").where("k = 1").first().v == 5


def test_upsert_writes_its_own_rows_and_merges_parts_in_time(spark, monkeypatch):
    """A batch writes no row of other keys until a bucket has too many parts; then one rewrite puts them together."""
    monkeypatch.setattr(keyed, "MOST_PARTS", 3)
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v long")
    for merge in (None, lambda rows: rows.groupBy("k").agg(F.min("v").alias("v"))):
        root = S.run_dir(spark, "keyed_parts_test")
        keyed.upsert(frame(*((i, i) for i in range(50)), (None, 3)), "k", root, 0, buckets=2, merge=merge)
        for b in range(1, 6):
            for _ in range(1 + (b == 4)):  # replayed
                keyed.upsert(frame((1, 10 - b), (None, None if b == 5 else b)), "k", root, b, buckets=2, merge=merge)
            assert spark.read.parquet(f"{root}/data/v={b}").count() == 2
            assert max(map(len, keyed._manifest(spark, root).values())) <= 3
        got = dict(map(tuple, keyed.table(spark, root, "k long, v long", "k", merge).collect()))
        want = {i: i for i in range(50)} | ({1: 1, None: 1} if merge else {1: 5, None: None})
        assert got == want and keyed.table(spark, root, "k long, v long", "k", merge).count() == 51


T0 = datetime(2024, 1, 1)
REPORTS = "share_token string, session_id string, created_at timestamp_ntz"


def update(i, text, at):
    return (f'{{"update_id": {i}, "message": {{"chat": {{"id": {i}}}, "text": "{text}"'
            + (f', "date": {int(at.replace(tzinfo=timezone.utc).timestamp())}' if at else "") + "}}",)


def test_reports_that_land_after_their_update_are_matched(spark):
    """By hand: the report of update 1 lands a run later, that of 2 is too old and that of 7 a day too
    young for the bounds, 3 is unknown, 4 has no time, 5 no token."""
    d = S.run_dir(spark, "match_test")
    day = timedelta(days=1)
    u_schema, r_schema = "update_json string", REPORTS
    lands = [
        ([update(1, "/start late", T0 + 40 * day), update(2, "/start old", T0 + 41 * day), update(3, "/start none", T0 + 41 * day),
          update(4, "/start old", None), update(5, "hi", T0 + 41 * day)], [("old", "s-old", T0)]),
        ([update(6, "/start late", T0 + 42 * day)], [("late", "s-late", T0 + 40 * day)]),
        ([update(7, "/start late", T0 + 39 * day)], []),
        ([update("null", "/start -", T0 + 500 * day)], [("--", None, T0 + 500 * day)])]
    for k, (ups, reps) in enumerate(lands):
        spark.createDataFrame(ups, u_schema).write.parquet(f"{d}/updates/f{k}") if ups else None
        spark.createDataFrame(reps, r_schema).write.parquet(f"{d}/reports/f{k}")
        D.match_streams(spark, d, spark.createDataFrame([], u_schema).schema, spark.createDataFrame([], r_schema).schema, "5 days")
    D.reply_streams(spark, d, spark.createDataFrame([], u_schema).schema)
    reports = spark.read.parquet(*(f"{d}/reports/f{k}" for k in range(4)))
    streamed = spark.read.schema(D.OUTCOME_SCHEMA + ", batch_id long").parquet(f"{d}/outcomes").where("update_id is not null")
    assert {r.update_id: r.session_id for r in streamed.where("found").collect()} == {1: "s-late", 6: "s-late"}
    assert {r.update_id for r in streamed.where("not found").collect()} == {2, 3, 7}
    got = {r.update_id: (r.outcome, r.session_id) for r in D.outcomes(spark, d, reports).where("update_id is not null").collect()}
    assert got == {1: ("delivered", "s-late"), 2: ("delivered", "s-old"), 3: ("not found", None), 4: ("delivered", "s-old"),
                   5: ("help", None), 6: ("delivered", "s-late"), 7: ("delivered", "s-late")}
    first = {r.token: r.ts for r in D.first_deliveries(spark, d, reports).collect()}
    assert first == {"late": T0 + 39 * day, "old": T0 + 41 * day}


def test_matching_builds_its_tables_once(spark):
    """However many slices, the rows of both tables are made once."""
    seen = spark.sparkContext.accumulator(0)
    u = [update(i, f"/start t{i}", T0 + timedelta(days=i))[0] for i in range(6)]
    r = [(f"t{i}", f"s{i}", T0 + timedelta(days=i)) for i in range(6)]

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    updates = spark.createDataFrame([(x,) for x in u], "update_json string").mapInPandas(counted, "update_json string")
    reports = spark.createDataFrame(r, REPORTS).mapInPandas(counted, REPORTS)
    d = D.run_matching(spark, "once_test", updates, reports)
    assert seen.value == 12
    got = D.outcomes(spark, d, D.staged_reports(spark, d, reports.schema)).where("update_id is not null").collect()
    assert {x.update_id: x.session_id for x in got} == {i: f"s{i}" for i in range(6)}


def test_ingest_from_json_landing(spark):
    from types import SimpleNamespace

    from leadlens.sources import adapters as A
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    tr = lambda s: A.messages(SimpleNamespace(conversations=s))
    got = S.ingest(spark, "json_ingest_test", conv, tr, fmt="json")
    exp = A.messages(SimpleNamespace(conversations=conv))
    assert sorted(rows(got, "id", "content", "created_at")) == sorted(rows(exp, "id", "content", "created_at"))
