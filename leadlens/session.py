"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so now-anchored buckets and ISO dates are
# engine-independent, AQE for runtime coalescing / skew-join splitting.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # JSON.parse keeps the last of duplicate keys; so does the variant parser with this on.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "leadlens") -> SparkSession:
    """Local/test session. On a cluster the submitter's session is used as is."""
    master = master or os.environ.get("LEADLENS_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("LEADLENS_DRIVER_MEM", "8g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
    for k, v in JOB_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_job_conf(spark)
    return spark


def apply_job_conf(spark: SparkSession) -> None:
    """Runtime-settable SQL confs; safe to call on a session we did not build."""
    for k, v in JOB_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a foreign session: keep theirs
            pass


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and snapshot tables.

    Read from ``spark.checkpoint.dir`` as the cluster names it; only when it
    is unset (local runs, tests) a scratch folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect session: no SparkContext
        pass
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        master = sc.master if sc is not None else ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="leadlens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - not settable at runtime here; the context still gets it
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")
