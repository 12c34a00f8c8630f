"""Helpers shared by the operators: table reading, lineage cuts, ASCII lower-casing."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from leadlens.session import checkpoint_root

#: Byte table that lower-cases A-Z and leaves every other byte alone (UTF-8 lead and trail bytes are above 0x7F).
LOWER_BYTES = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


#: Documents in an Arrow batch.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z only; ``lower()`` would change other letters too."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage (a lost executor re-reads files) and, unlike ``checkpoint()``, forgets the old partitioning,
    so later joins see two plain shuffles, which AQE can split when a key is hot. The files stay, below ``llm`` in that
    folder: results that have not been computed yet may still read them, so dropping them is the caller's decision.
    """
    path = f"{checkpoint_root(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder. The files stay until they are deleted there, unless the session has
    spark.cleaner.referenceTracking.cleanCheckpoints on."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def map_batches(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of at most BATCH_ROWS rows: texts may be long, and the JVM's buffers and the
    worker's copies are as large as a batch (Spark bounds its bytes too, by arrow.maxBytesPerBatch).

    Spark takes the batch size from the session when the job runs, so this lowers
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` of the session and leaves it lowered; a smaller one stays."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(size)) <= BATCH_ROWS:
        df.sparkSession.conf.set(size, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def with_field(schema: StructType, name: str, kind: DataType) -> StructType:
    """A new schema with one more field (``StructType.add`` would change the given one)."""
    return StructType([*schema.fields, StructField(name, kind)])


def own_columns(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of ``df``'s (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
