"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. Shuffle partition counts are left to AQE, which coalesces small ones and splits skewed ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "coordweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only where none is configured (local tests)."""
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = os.path.join(tempfile.mkdtemp(prefix="coordweave-"), "checkpoints")
    context.setCheckpointDir(configured)
    return configured


def write_parts(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in folders by ``by`` and sorted by ``order``."""
    path = f"{checkpoint_dir(df.sparkSession)}/parts-{uuid.uuid4().hex}"
    df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles both sides.

    The planner takes the size of packed files for the size of rows, and knows nothing of rows that an array is about to become:
    it would collect tables on the driver that are a hundred times what it allows. For tables that grow with the input.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that iterative plans stay short and survive the loss of executors.

    Written to the checkpoint folder as Parquet: by columns and packed, where a checkpoint keeps every row as it lies in memory.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
