"""Property checks: column expressions against plain-Python statements of the same rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadlens.functions import exprs as X
from leadlens.operators import metrics as M
from leadlens.sources.adapters import ts_lit
from tests.conftest import rows


def phone_rule(s):
    """Digits only; one leading 00 dropped; 998+9, 9, or 0+9 digits accepted."""
    if s is None:
        return None
    d = re.sub(r"[^0-9]", "", s)
    if d.startswith("00"):
        d = d[2:]
    if len(d) == 12 and d.startswith("998"):
        return "+" + d
    if len(d) == 9:
        return "+998" + d
    if len(d) == 10 and d.startswith("0"):
        return "+998" + d[1:]
    return None


spellings = st.lists(st.one_of(
    st.none(),
    st.text(alphabet="0123456789 +-()", max_size=16),
    st.builds(lambda p, n, sep: p + sep.join([n[:2], n[2:5], n[5:7], n[7:]]),
              st.sampled_from(["", "0", "00", "998", "+998", "00998", "+7"]),
              st.text(alphabet="0123456789", min_size=9, max_size=9), st.sampled_from(["", " ", "-"]))),
    min_size=1, max_size=120)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=spellings)
def test_normalize_phone_matches_rule(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in rows(df.orderBy("i").select(X.normalize_phone(F.col("v"))))]
    assert got == [phone_rule(v) for v in values]


def test_weekly_funnel_never_exceeds_sources(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    mapped = ev.select(F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "view", "finished")
                       .when(F.col("event_type") == "click", "contact").when(F.col("event_type") == "purchase", "delivered")
                       .alias("metric"), "ts").filter(F.col("metric").isNotNull())
    b = M.weekly_funnel(mapped, ts_lit("2024-01-31 00:00:00")).agg(*[F.sum(m).alias(m) for m in M.FUNNEL_METRICS])
    totals = dict(rows(mapped.groupBy("metric").count()))
    got = b.collect()[0]
    assert all(got[m] <= totals[m] for m in M.FUNNEL_METRICS)
    assert got["started"] > 0
