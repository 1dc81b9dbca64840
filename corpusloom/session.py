"""Session helpers: shared scratch tables, size checks before broadcasting, scan parallelism."""

from __future__ import annotations

import tempfile
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup above either limit is joined by shuffling instead of being sent to every executor.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
# A lookup within these limits may be written into the expression itself.
INLINE_ROWS = 100_000
INLINE_BYTES = 4 * 1024 * 1024


def build_session(app_name: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; the cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="corpusloom-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting. All paths of one application share a folder,
    so that one removal cleans up after it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup_size(lookup: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes of a lookup table, from one aggregate row.

    Texts count as they are, arrays, maps and structs as they would be written, others as 8 bytes.
    """
    flat = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    texts = [F.col(f.name).cast("string") for f in lookup.schema.fields if not isinstance(f.dataType, flat)]
    width = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(8 * (len(lookup.columns) - len(texts))))
    row = lookup.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("bigint")).alias("b")).first()
    return row["n"], row["b"] or 0


def fits_inline(rows: int, size: int) -> bool:
    return rows <= INLINE_ROWS and size <= INLINE_BYTES


def fits_broadcast(rows: int, size: int) -> bool:
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` when the scan has too few splits to occupy the cluster.

    A small file with one row group is read by one task however many cores there are. A large
    table has far more splits than cores and is returned as it is, without a shuffle.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)
