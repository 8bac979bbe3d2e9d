"""Writers: partitioned Parquet of runs, CSV exports, metrics as JSON, models, and text reports from small tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(path: str, run_id: str, **tables: DataFrame) -> None:
    """Each table under path/<name>/run_id=<run_id>, as Parquet."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path.rstrip('/')}/{name}")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_prices(df: DataFrame, path: str) -> None:
    """Long prices by series and year, so that reads prune to what they ask for."""
    df.withColumn("year", F.year("ts")).repartition("series_id", "year").write.mode("overwrite").partitionBy("series_id", "year").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def report(title: str, df: DataFrame, rows: int | None = None) -> str:
    """A plain text table of a small result; of more than ``rows`` rows, if given, the first ones and how many are left out."""
    got = df.collect() if rows is None else df.limit(rows + 1).collect()
    more = rows is not None and len(got) > rows
    got = got[:rows] if more else got
    cells = [df.columns, *[[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in got]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([title, "=" * len(title), *lines, *([f"... and {df.count() - rows} more rows"] if more else []), ""])


def full_report(title: str, **sections: DataFrame) -> str:
    """One text of several tables, such as performance, comparison, trades and validation of a run."""
    return "\n".join([title, "#" * len(title), "", *[report(name.replace("_", " ").capitalize(), df) for name, df in sections.items()]])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report as a text file, where Spark writes."""
    spark.createDataFrame([(x,) for x in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)
