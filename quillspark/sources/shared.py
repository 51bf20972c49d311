"""What driver and executors share: the folder of intermediate tables, and the package itself."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a folder below the
    local temporary one is taken; on a cluster that would lose rows, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/quillspark-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/quillspark"


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package when it is run from a checkout."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def materialise(df: DataFrame, label: str, group: int | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts lineage, survives lost executors.

    `group` is how many rows a row group holds at most: a task that reads wide rows has one
    in memory, and a file of them can be split.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", group) if group else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
