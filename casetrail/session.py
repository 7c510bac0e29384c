"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: list[str] = []


def build_session(app: str = "casetrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; cluster defaults win for the rest."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the cluster names none, a local-mode session gets a folder of its own (tests, a
    laptop); on a cluster a machine-local folder would be lost with the machine, so that is
    refused.
    """
    found = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        _CHECKPOINT_KEY, None
    )
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set(_CHECKPOINT_KEY, made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables this process has made; call it when a job's results are written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        place.getFileSystem(hadoop).delete(place, True)


def write_through(df: DataFrame, label: str, keep_shuffles: bool = True) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage with data that outlives any executor.  Without ``keep_shuffles`` the job's
    shuffle files leave the disk as soon as the table is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP_KEY, None)
    if not keep_shuffles:
        spark.conf.set(_CLEANUP_KEY, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP_KEY, before)
        elif not keep_shuffles:
            spark.conf.unset(_CLEANUP_KEY)
    return spark.read.schema(df.schema).parquet(path)
