"""What several operators share: written tables, checked broadcasts, row keys, patterns."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows up to which a small side may be broadcast (a few tens of MB at the widths used here).
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one in local mode, as
    in tests; on a cluster, whose executors would each write to a disk of their own, an error."""
    if (dir_ := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return dir_
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints/strandline"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, if the (written, cheap to count) df has at most so many rows; else df, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def row_key(id_col: str | Column, text_col: str | Column) -> list[Column]:
    """96 bits that name a row by its id and text, never null: rows alike in both are one document."""
    i, t = (F.col(c) if isinstance(c, str) else c for c in (id_col, text_col))
    return [F.xxhash64(i, t).alias("_k1"), F.hash(t, i).alias("_k2")]


def boxed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row (all columns), _k1, _k2: rows with their key, safe from clashes of column names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key(id_col, text_col))


def unboxed(columns: list[str]) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
