"""Calendar exports as event rows, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import ics_start


def read_ics(spark: SparkSession, path: str, local_zone: str = "America/Los_Angeles") -> DataFrame:
    """Events of ICS files: started_at (local), summary, description, status, uid.

    The block start is the record separator, so large exports are read by many tasks.
    """
    blocks = spark.read.option("lineSep", "BEGIN:VEVENT").text(path)
    return parse_ics(blocks.withColumnRenamed("value", "block"), local_zone)


def parse_ics(blocks: DataFrame, local_zone: str) -> DataFrame:
    inside = blocks.where(F.contains("block", F.lit("END:VEVENT"))).select(
        F.regexp_replace(F.substring_index("block", "END:VEVENT", 1), r"\r?\n[ \t]", "").alias("block"))

    def part(name: str, group: int) -> Column:
        return F.regexp_extract("block", rf"(?m)^{name}((?:;[^:\r\n]*)?):([^\r\n]*)", group)

    def text(name: str) -> Column:
        value = part(name, 2)
        for escaped, plain in (("\\n", " "), ("\\N", " "), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
            value = F.replace(value, F.lit(escaped), F.lit(plain))
        return F.trim(value)

    start = F.nullif(part("DTSTART", 2), F.lit(""))
    return inside.select(
        ics_start(start, part("DTSTART", 1), local_zone).alias("started_at"),
        text("SUMMARY").alias("summary"), text("DESCRIPTION").alias("description"),
        text("STATUS").alias("status"), text("UID").alias("uid"))
