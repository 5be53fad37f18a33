"""Session-level helpers: shared folder, durable tables, input spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session setting: deal inputs with fewer row groups than cores out over this many partitions.
SPREAD_SETTING = "labelspring.spread.partitions"

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without it; it then gets a temporary
    folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir must name a folder shared by all executors"
        )
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="labelspring-")
    return _local_roots[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark)}/labelspring/{uuid.uuid4().hex}/{name}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of any executor, and gives the planner
    exact sizes, so small tables are broadcast without a hint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out over as many partitions as the session setting names; unset, nothing moves.

    A single row group is read by a single task, and everything narrow after
    that would stay in it.  Inputs with enough row groups have the parallelism
    already.  The size of the input plays no part: the same setting gives the
    same plan at every size.
    """
    partitions = df.sparkSession.conf.get(SPREAD_SETTING, None)
    return df if partitions is None else df.repartition(int(partitions), key)
