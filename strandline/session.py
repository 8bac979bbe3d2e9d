"""Session factory: UTC, adaptive execution, no machine-local assumptions."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "strandline", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for local work; on a cluster the submitted configuration wins (getOrCreate)."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one in local mode, as in
    tests; on a cluster, whose executors would each write to a disk of their own, an error."""
    if (dir_ := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return dir_.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints/strandline"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: for tables that many jobs read, and to cut lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
