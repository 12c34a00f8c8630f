"""Registered jobs: one callable (spark, sf_dir) -> DataFrame per key.

Each job reads the driver tables through the adapter views and calls the
library operators; nothing here collects to the driver. Outputs are flat
(scalars only) so they can be compared value by value with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.session import apply_job_conf
from leadlens.sources import adapters as A
from leadlens.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def job(name: str, spread: bool = False):
    """Register a job. ``spread``: per-row work is heavy (text parsing), so
    scans with fewer splits than the cluster's parallelism are spread first."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_job_conf(spark)
            return fn(Tables(spark, sf_dir, min_splits=None if spread else 1))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def events_as_of():
    return A.ts_lit(A.EVENTS_AS_OF)


def entity_as_of():
    return A.ts_lit(A.ENTITY_AS_OF)


# Job modules register themselves on import.
from leadlens.plans import (jobs_conversations, jobs_identity, jobs_leads, jobs_metrics,  # noqa: E402,F401
                            jobs_reports, jobs_rubric, jobs_streams)
