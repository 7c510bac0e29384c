"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

A node that is to hold L shards is split along its widest dimension (relative to the dimension's whole width; ties to
the first) at the weighted quantile ``L div 2 / L`` of its bytes, until every leaf is one shard of the target bytes.
The quantile is exact: rows order by (coordinate, id), and histograms over the range that holds the quantile, all
nodes of a level at once, narrow it down to one coordinate, then to one id, then to one row; it goes left if that leaves the
left side nearer to its goal. So the error of a split is at most half a row, whatever the ties.

Only histograms are shuffled (combined before the shuffle), a hot source or group of copies is cut by id, and the text
is read once. States per node are tables in the shared folder; nothing passes the driver but the end of each search.

Null texts have the base size and checksum 0, null ids count as 0 and null sources as empty; rows that agree in id and
coordinate are told apart by the checksum of their text, repeated rows by their place in the measured table, so that any
number of null or equal ids is cut as well; an empty table has no shards. Ids are taken to lie within plus and minus 2**62.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sums, written

BASE_BYTES = 8
BINS = 1 << 16
BUCKET_ROWS = 50_000
DIMENSIONS = ("d_id", "d_chars", "d_source", "d_lang")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             lang_col: str = "lang") -> DataFrame:
    """(id, size, text_crc32) and the coordinates of every row, without the text."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + BASE_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("d_id"),
        F.length(text).cast("long").alias("d_chars"), F.crc32(F.coalesce(source_col, F.lit(""))).alias("d_source"),
        F.crc32(F.coalesce(lang_col, F.lit(""))).alias("d_lang"))


def _chosen() -> Column:
    """The coordinate of a row along the dimension of its node's state."""
    return F.element_at(F.array(*DIMENSIONS), F.col("dim"))


def _states(rows: DataFrame, whole: dict[str, int]) -> DataFrame:
    """The nodes to split: dimension, bytes meant for the left side, and the range that holds the quantile."""
    ranges = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    s = rows.where("leaves > 1").groupBy("node", "leaves").agg(F.sum("size").alias("total"), *ranges)
    widths = F.array(*((F.col(f"max_{d}") - F.col(f"min_{d}")) / F.lit(float(max(1, whole[d]))) for d in DIMENSIONS))
    s = s.withColumn("dim", F.array_position(widths, F.array_max(widths)).cast("int"))
    half = F.floor(F.col("leaves") / 2)
    # floor(total * half / leaves) without a product that could overflow
    goal = F.expr("total div leaves") * half + F.floor(F.col("total") % F.col("leaves") * half / F.col("leaves"))
    low, high = (F.element_at(F.array(*(F.col(f"{k}_{d}") for d in DIMENSIONS)), F.col("dim")) for k in ("min", "max"))
    return s.select("node", "dim", half.alias("half"), goal.alias("goal"), low.alias("low"), high.alias("high"),
                    F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("weight"),
                    F.col("min_d_id").alias("low_id"), F.col("max_d_id").alias("high_id"))


def _searched(rows: DataFrame, states: DataFrame, position: Column, only: Column) -> DataFrame:
    """States whose range is narrowed to the one position where the running bytes pass the goal."""
    keep = [c for c in states.columns if c not in ("below", "weight", "rows")]
    running = Window.partitionBy("node").orderBy("bin")  # at most BINS rows per node
    while True:
        step = F.expr(f"(high - low) div {BINS} + 1")
        ahead = position - F.col("low")
        place = F.round((ahead - ahead % F.col("step")) / F.col("step")).cast("long")   # exact: a whole number of steps
        bins = (rows.join(states.withColumn("step", step), "node")
                .where(only & (position >= F.col("low")) & (position <= F.col("high")))
                .groupBy(*keep, "below", "step", place.alias("bin"))
                .agg(F.sum("size").alias("weight"), F.count("*").alias("rows"))
                .withColumn("before", F.sum("weight").over(running) - F.col("weight")))
        passed = F.min(F.when(F.col("below") + F.col("before") + F.col("weight") > F.col("goal"),
                              F.struct("bin", "before", "weight", "rows"))).alias("p")
        found = bins.groupBy(*keep, "below", "step").agg(passed)
        start = F.col("low") + F.col("p.bin") * F.col("step")
        states = written(found.select(
            *(c for c in keep if c not in ("low", "high")), start.alias("low"),
            F.least(F.col("high"), start + F.col("step") - 1).alias("high"),
            (F.col("below") + F.col("p.before")).alias("below"), F.col("p.weight").alias("weight"), F.col("p.rows").alias("rows")), "kd-state")
        if not states.where("high > low").limit(1).count():
            return states


def kd_tree(rows: DataFrame, shards: int) -> DataFrame:
    """Rows with ``shard``: leaves of near equal bytes, numbered from left to right."""
    low = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))   # fixed once the table is written
    rows = written(rows.withColumn("row", F.col("text_crc32") * (1 << 30) + low).withColumn("node", F.lit(0).cast("long")).withColumn("leaves", F.lit(shards).cast("long")), "kd")
    first = rows.agg(*(f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max))).first()
    whole = {d: (first[f"max_{d}"] or 0) - (first[f"min_{d}"] or 0) for d in DIMENSIONS}
    for _ in range((shards - 1).bit_length()):
        along = _searched(rows, written(_states(rows, whole), "kd-state"), _chosen(), F.lit(True))
        along = along.select("node", "dim", "half", "goal", F.col("low").alias("cut"), F.col("low_id").alias("low"),
                             F.col("high_id").alias("high"), "below", "weight")
        split = _searched(rows, along, F.col("d_id"), _chosen() == F.col("cut")).select(
            "node", "dim", "half", "goal", "cut", F.col("low").alias("cut_id"), "below", "weight", "rows")
        last = F.lit((1 << 62) - 1)
        if split.where("rows > 1").limit(1).count():   # rows of one id at the cut: among them the row decides
            among = (_chosen() == F.col("cut")) & (F.col("d_id") == F.col("cut_id"))
            split = _searched(rows, split.select(*split.columns, F.lit(0).cast("long").alias("low"), last.alias("high")),
                              F.col("row"), among).withColumnRenamed("low", "cut_row")
        else:
            split = split.withColumn("cut_row", last)
        key_left = (2 * F.col("below") + F.col("weight") <= 2 * F.col("goal")).alias("key_left")
        split = split.select("node", "dim", "half", "cut", "cut_id", "cut_row", key_left)
        x = _chosen()
        at_row = F.when(F.col("row") == F.col("cut_row"), F.col("key_left")).otherwise(
            F.when(F.col("cut_row") == last, F.col("key_left")).otherwise(F.col("row") < F.col("cut_row")))
        left = (x < F.col("cut")) | (x == F.col("cut")) & (
            (F.col("d_id") < F.col("cut_id")) | (F.col("d_id") == F.col("cut_id")) & at_row)
        rows = rows.join(split, "node", "left")
        rows = written(rows.select(
            "id", "size", "text_crc32", "row", *DIMENSIONS,
            F.when(F.col("dim").isNull() | left, F.col("node")).otherwise(F.col("node") + F.col("half")).alias("node"),
            F.when(F.col("dim").isNull(), F.col("leaves")).when(left, F.col("half"))
            .otherwise(F.col("leaves") - F.col("half")).alias("leaves")), "kd")
    return rows.withColumnRenamed("node", "shard").drop("leaves")


def shards(rows: DataFrame, count: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Rows with ``shard`` and ``slot`` (gapless from 0 in each shard), for a number of shards or a target size."""
    rows = written(rows, "measured")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cut = kd_tree(rows, count or max(1, -(-total // target_bytes)))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(n // BUCKET_ROWS + 1))).withColumn("one", F.lit(1).cast("long"))
    return prefix_sums(cut, ["d_id", "size", "text_crc32"], "one", "slot", "shard").drop("bucket", "one", "row")
