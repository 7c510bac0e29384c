"""Reports and snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.predicates import drop_content
from ..operators.ranking import newest_first


def write_jobs_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """Jobs, best first, as CSV with the sixteen report columns and a header; all of them without a ``limit``."""
    best = newest_first(df, [F.desc("score"), F.desc("last_seen_at"), F.asc("id")], limit)
    columns = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in fixed.JOB_CSV_FIELDS]
    best.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report_groups(spark: SparkSession, path: str) -> DataFrame:
    """(message_id, records) of a written report: its rows are jobs, one group of them for each message id."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.groupBy("message_id").agg(F.count("*").cast("string").alias("records"))


def write_snapshot(frames: Mapping[str, DataFrame], path: str, version: str = fixed.SNAPSHOT_VERSION):
    """Aggregate frames as one Parquet folder each; the version is written last, as the mark of a
    complete snapshot.  Frames with message content are refused."""
    for name, df in frames.items():
        drop_content(df).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(version, n) for n in frames], "version string, frame string").coalesce(
        1).write.mode("overwrite").parquet(f"{path}/_meta_")


def load_snapshot(spark: SparkSession, path: str, version: str = fixed.SNAPSHOT_VERSION):
    """Frames by name; None where there is no snapshot; an error for another version."""
    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.schema("version string, frame string").parquet(f"{path}/_meta_").collect()
    except AnalysisException:
        return None
    if any(row.version != version for row in meta):
        raise ValueError("unsupported snapshot version")
    return {row.frame: spark.read.parquet(f"{path}/{row.frame}") for row in meta}
