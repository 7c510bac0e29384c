"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casetrail.session import scratch_path


ROWS_AT_ONCE = 1_000
SLICE_BYTES = 1 << 21
#: words in one text for a tokenizer, and texts in one call of it
TOGETHER = 64
CALL = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, safe when executors are lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_batch(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``fn`` over Arrow batches, ``ROWS_AT_ONCE`` rows at a time; more is never held besides the batch that came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield fn(batch.slice(at, ROWS_AT_ONCE))

    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hex_sha256(column) -> F.Column:
    """Lowercase hex of a binary or text column, null as empty."""
    return F.sha2(F.coalesce(column.cast("binary"), F.lit(b"")), 256)


def prefix_sums(rows: DataFrame, order: list[str], value: str, out: str, group: str = "sid",
                bucket: str = "bucket") -> DataFrame:
    """Exclusive prefix sums per group in the order (bucket, order), in two steps: no task holds a whole group."""
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    above = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, [group, bucket])
    return rows.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_base")


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of the column ``text``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.slice(a, b - a)


def ragged(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the lists ``rows`` one after another, their lengths) of lists that lie in ``flat`` between ``offsets``."""
    begin = offsets[rows]
    lengths = offsets[rows + 1] - begin
    shift = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
    return flat[np.arange(len(shift)) + shift], lengths


def encoded(parting, plain, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids of each word) of words that a ``tokenizers`` encoder encodes each on its own.

    Words go many to a text, parted by the first special token of ``parting``; a word that holds its text, and every word
    where there is none, is encoded alone by ``plain`` (the same tokenizer, which may read special tokens as plain text).
    """
    mark_id, mark = next(((i, t.content) for i, t in parting.get_added_tokens_decoder().items() if t.special), (-1, ""))
    alone = np.array([not mark or mark in w for w in words], bool)
    sizes, flats = np.zeros(len(words), np.int64), [np.zeros(0, np.int64)]
    for places, together in ((np.flatnonzero(~alone), TOGETHER), (np.flatnonzero(alone), 1)):
        encoder = parting if together > 1 else plain
        for at in range(0, len(places), together * CALL):
            runs = [places[i:i + together] for i in range(at, min(at + together * CALL, len(places)), together)]
            texts = [mark.join([words[i] for i in run.tolist()]) for run in runs]
            for run, found in zip(runs, encoder.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(found.ids, np.int64)
                marks = np.flatnonzero(ids == mark_id) if together > 1 else np.zeros(0, np.int64)
                sizes[run] = np.diff(marks, prepend=-1, append=len(ids)) - 1
                flats.append(np.delete(ids, marks) if len(marks) else ids)
    order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
    offsets = np.concatenate([[0], np.cumsum(sizes[order])])
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return ragged(np.concatenate(flats), offsets, place)[0], sizes
