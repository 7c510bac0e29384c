"""Incremental ingest of landed message files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path


def stream_messages(
    spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """Stream over the Parquet files that land in a folder; the query checkpoint remembers which
    were read."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(path))


def dedupe_stream(df: DataFrame, key: str, at: str, horizon: str = "7 days") -> DataFrame:
    """First message per identity within the horizon.  State is bounded by it; identities older
    than that are caught by :func:`append_new`."""
    return df.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])


def append_new(spark: SparkSession, table: str, schema: StructType, key: str):
    """A ``foreachBatch`` function that appends identities the table does not hold yet.

    The table is partitioned by a prefix of the hashed identity and a batch is compared with its
    own prefixes only.  Writing a batch twice adds nothing.
    """
    from ..operators.identity import new_only

    def bucket() -> Column:
        return F.substring(F.sha2(F.col(key), 256), 1, 2)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("_prefix", bucket())
        try:
            known = session.read.schema(rows.schema).parquet(table)
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            known = session.createDataFrame([], rows.schema)
        new_only(rows, known.select(key, "_prefix"), key).write.mode("append").partitionBy(
            "_prefix").parquet(table)

    return write


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Processes what has landed and returns the result as a table in the shared folder.

    ``append`` results go to a file sink; ``complete`` and ``update`` results are aggregates,
    which each batch replaces.
    """
    spark = stream.sparkSession
    target, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(target)
    else:
        def replace(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(target)

        query = writer.outputMode(mode).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def run_updates(stream: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Processes what has landed and returns the last row of every key of an ``update`` stream.

    Each batch writes a folder of its own, so that a batch that runs again replaces only what it wrote.
    """
    spark = stream.sparkSession
    target, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    schema = StructType(list(stream.schema.fields)).add("batch", "long")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = stream.writeStream.option("checkpointLocation", state).trigger(
        availableNow=True).outputMode("update").foreachBatch(put).start()
    query.awaitTermination()
    if not query.recentProgress:
        return spark.createDataFrame([], stream.schema)
    others = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*others), "batch").alias("_newest")
    return spark.read.schema(schema).parquet(target).groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def run_batches(stream: DataFrame, write, label: str) -> None:
    """Processes what has landed through a ``foreachBatch`` function."""
    state = scratch_path(stream.sparkSession, f"{label}-state")
    stream.writeStream.option("checkpointLocation", state).trigger(
        availableNow=True).foreachBatch(write).start().awaitTermination()


def tumbling_counts(df: DataFrame, at: str, keys: Sequence[str] = (), delay: str = "7 days"):
    """Counts per day (and key) by event time."""
    return df.withWatermark(at, delay).groupBy(F.window(at, "1 day"), *keys).agg(
        F.count("*").alias("n")).select(
        F.col("window.start").cast("date").cast("string").alias("day"), *keys, "n")


def sliding_counts(df: DataFrame, at: str, days: int, delay: str = "7 days") -> DataFrame:
    """Counts of the rolling windows of ``days`` days that end on each day."""
    return df.withWatermark(at, delay).groupBy(F.window(at, f"{days} days", "1 day")).agg(
        F.count("*").alias("n")).select(
        F.date_sub(F.col("window.end").cast("date"), 1).cast("string").alias("end_date"), "n")


# --- checkpoints ------------------------------------------------------------------------------


def contiguous_watermark(
    scanned: DataFrame, scope: Sequence[str], uid: str = "uid", failed: str = "failed",
    previous: DataFrame | None = None, strict: bool = False,
) -> DataFrame:
    """Highest id up to which everything succeeded, per scope; never lower than before.

    With ``strict`` a scope with a failure keeps its previous mark.
    """
    first_bad = F.min(F.when(F.col(failed), F.col(uid)))
    marks = scanned.groupBy(*scope).agg(
        first_bad.alias("_bad"), F.max(uid).alias("_top"), F.count_if(failed).alias("failure_count"),
        F.count("*").alias("scanned_count"))
    if previous is not None:
        marks = marks.join(previous.select(*scope, F.col("last_successful_uid").alias("_old")),
                           list(scope), "left")
    else:
        marks = marks.withColumn("_old", F.lit(None).cast("bigint"))
    old = F.coalesce("_old", F.lit(0))
    reached = F.when(F.col("_bad").isNull(), F.col("_top")).otherwise(
        F.col("_old") if strict else F.col("_bad") - 1)
    return marks.select(*scope, F.greatest(old, reached).alias("last_successful_uid"),
                        "scanned_count", "failure_count")


CHECKPOINT_KEYS = ("provider", "account", "folder", "since_date")


def upsert_checkpoint(
    current: DataFrame, run: DataFrame, keys: Sequence[str] = CHECKPOINT_KEYS,
    at: str = "completed_at",
) -> DataFrame:
    """The newest run per scope replaces its checkpoint; other scopes are untouched."""
    from ..operators.merge import latest

    both = current.unionByName(run)
    return latest(both, list(keys), [at])


def namespace_guard(
    current: DataFrame, run: DataFrame, keys: Sequence[str] = CHECKPOINT_KEYS,
    namespace: str = "uidvalidity",
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) runs: a scope whose id namespace changed stops."""
    old = current.select(*keys, F.col(namespace).alias("_old"))
    joined = run.join(old, list(keys), "left")
    changed = F.col("_old").isNotNull() & (F.col("_old") != F.col(namespace))
    return joined.where(~changed).drop("_old"), joined.where(changed)


def scan_metrics(
    scanned: DataFrame, scope: Sequence[str], uid: str = "uid", failed: str = "failed",
    at: str = "ts",
) -> DataFrame:
    """Processed, completed and failed counts, first and last id, and rate per second."""
    seconds = (F.timestamp_diff("MICROSECOND", F.min(at), F.max(at)) / 1e6)
    return scanned.groupBy(*scope).agg(
        F.count("*").alias("processed"), F.count_if(~F.col(failed)).alias("completed"),
        F.count_if(failed).alias("failed"), F.min(uid).alias("first_uid"),
        F.max(uid).alias("last_uid"),
        F.coalesce(F.round(F.try_divide(F.count("*"), seconds), 3), F.lit(0.0)).alias("per_second"))
