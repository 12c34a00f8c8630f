"""Driver contract: every registered job returns flat, uniquely named columns."""

from pyspark.sql import types as T

import __spark_entry__ as E
from leadlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
SCALARS = (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.BooleanType, T.TimestampNTZType,
           T.TimestampType, T.DateType)


def test_outputs_are_flat_and_unique(spark):
    bad = {}
    for k, fn in QUERIES.items():
        if k.startswith(("stream_", "ingest_", "webhook_", "delivery_replies", "retention_", "erase_")):
            continue  # these run a stream or write a snapshot; schema checked in their own tests
        schema = fn(spark, SF).schema
        names = [f.name for f in schema.fields]
        nested = [f.name for f in schema.fields if not isinstance(f.dataType, SCALARS)]
        if len(set(names)) != len(names) or nested:
            bad[k] = (names, nested)
    assert bad == {}


def test_oracle_keys_are_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
