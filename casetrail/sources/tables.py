"""Business tables, activity logs and funnel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import serial_date


def read_table(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None):
    """A business table with its declared schema; a column the files lack is read as NULL."""
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df


def read_activity_log(spark: SparkSession, path: str) -> DataFrame:
    """(day, applications) from a CSV of spreadsheet serial days and counts.

    Rows that are not numeric in both cells (headings, notes) are dropped.
    """
    return parse_activity_log(spark.read.schema("serial string, count string").csv(path))


def parse_activity_log(rows: DataFrame) -> DataFrame:
    serial, count = (F.trim(c).try_cast("double") for c in ("serial", "count"))
    numeric = rows.select(serial.alias("serial"), count.alias("count")).where(
        "serial IS NOT NULL AND count IS NOT NULL")
    return numeric.select(
        serial_date("serial").alias("day"), F.col("count").cast("bigint").alias("applications"))


FUNNEL_SCHEMA = (
    "label string, applications string, hm_team string, hm_rate string, finals string, "
    "final_rate string, offers string"
)


def read_funnel(spark: SparkSession, path: str) -> DataFrame:
    """A funnel table as printed ("1,234", "6.8%") with numeric columns."""
    return parse_funnel(spark.read.option("header", True).schema(FUNNEL_SCHEMA).csv(path))


def parse_funnel(rows: DataFrame) -> DataFrame:
    def number(c: str):
        return F.trim(F.replace(F.col(c), F.lit(","), F.lit(""))).cast("bigint").alias(c)

    def percent(c: str):
        return F.trim(F.replace(F.col(c), F.lit("%"), F.lit(""))).cast("double").alias(c)

    return rows.select("label", number("applications"), number("hm_team"), percent("hm_rate"),
                       number("finals"), percent("final_rate"), number("offers"))
