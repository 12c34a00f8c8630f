"""leadlens — Spark-native analytics over assessment sessions, leads and reports.

Every job is a function DataFrame(s) -> DataFrame built from Spark SQL
built-in expressions, so Catalyst can push filters and prune columns into
the Parquet scans and whole-stage codegen keeps the hot path in the JVM.
The only Python on the data path is the per-key admission limiter
(grouped map / stateful processor), whose recurrence no window can express.
"""

from leadlens.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
