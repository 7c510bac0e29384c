"""SimHash near-duplicates: fingerprints of word shingles, linked exactly through vantage-point trees.

A fingerprint bit is set where more than half of the shingle hashes have it. Only distinct fingerprints are linked; the
documents of one fingerprint are one class from the start.

Linking is an exact self-join within ``RADIUS`` differing bits. The root level of each tree uses the Hamming distance
within some of ``blocks`` disjoint bit blocks: two linked fingerprints agree (distance 0) in at least ``blocks - RADIUS``
blocks, so every choice of that many blocks gives one tree whose root shards do not overlap, and no link is lost
over all choices. Below the root a tree splits at the median Hamming distance to a vantage point; by the triangle
inequality a query goes to one side only, unless its distance lies within the radius of the boundary, when it goes to
both. All fingerprints within the radius of a vantage point are one component at once, so dense clusters cost little.
``blocks`` follows from the number of fingerprints: enough agreeing bits that a shard expects few.

Shards of more than ``SHARD_ROWS`` fingerprints are cut into chunks and every pair of chunks is one task's work, so
memory is bounded for any clustering. A shard returns the links of a spanning forest, never all pairs.

Texts without words have fingerprint 0. Null texts are empty; a null id is never the representative of others (a group
of null ids only has component null); repeated rows are rows of one class; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.operators.components import component_roots

from .common import by_batch, written

WORDS_PER_SHINGLE = 4
SEED = 42
RADIUS = 4
LEAF = 48
SHARD_ROWS = 20_000
EXPECTED_ROWS = 4_096
CHUNK = 1 << 16


def _hashes(text: str, k: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, in arrays of bounded length."""
    words = text.encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, digest = max(1, len(words) - k + 1), xxhash.xxh64_intdigest
    first, last = starts[:n], ends[min(k, len(words)) - 1:]
    for at in range(0, n, CHUNK):
        pairs = zip(first[at:at + CHUNK].tolist(), last[at:at + CHUNK].tolist())
        yield np.array([digest(line[a:b], SEED) for a, b in pairs], dtype=np.uint64)


def fingerprint(text: str, k: int = WORDS_PER_SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    n, counts = 0, np.zeros(64, np.int64)
    for h in _hashes(text, k):
        n += len(h)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return sum(1 << i for i in np.nonzero(2 * counts > n)[0].tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(id, fingerprint long) of every whole text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t.as_py() or "", k) for t in batch.column(1)], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "fingerprint"])

    return by_batch(docs.select(id_col, text_col), f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint long", run)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius, a bounded block of rows at a time."""
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at:at + step, None] ^ b[None, :]) <= radius)
        yield i + at, j


def tree_links(values: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """Pairs (i, j) that connect exactly the fingerprints connected by distances of at most ``radius``."""
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = root(i), root(j)
            parent[max(i, j)] = min(i, j)

    work = [(np.arange(len(values)), np.arange(len(values)))]
    while work:
        points, queries = work.pop()
        if len(points) <= leaf or not len(queries):
            for i, j in _near(values[points], values[queries], radius):
                differ = points[i] < queries[j]
                link(points[i][differ], queries[j][differ])
                differ = points[i] > queries[j]
                link(points[i][differ], queries[j][differ])
            continue
        vantage = points[len(points) // 2]
        to_points = np.bitwise_count(values[points] ^ values[vantage])
        to_queries = np.bitwise_count(values[queries] ^ values[vantage])
        ball, rest = points[to_points <= radius], to_points > radius
        for near in (ball, queries[to_queries <= radius]):
            link(np.full(len(near), vantage), near)
        # what is within the radius is linked by now; queries beyond two radii cannot meet the ball
        edge = queries[(to_queries > radius) & (to_queries <= 2 * radius)]
        for i, j in _near(values[edge], values[ball], radius):
            link(edge[i], ball[j])
        points, to_points = points[rest], to_points[rest]
        if not len(points):
            continue
        boundary = int(np.median(to_points))
        inner = to_points <= boundary
        work.append((points[inner], queries[to_queries <= boundary + radius]))
        work.append((points[~inner], queries[to_queries.astype(np.int64) > boundary - radius]))
    roots = np.array([root(i) for i in range(len(values))], dtype=np.int64)
    moved = np.nonzero(roots != np.arange(len(values)))[0]
    return np.column_stack([moved, roots[moved]])


def block_masks(rows: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the root levels: each choice of agreeing blocks, for the fewest blocks that give small shards."""
    for agreeing in range(1, 9):
        blocks = radius + agreeing
        edges = [64 * i // blocks for i in range(blocks + 1)]
        bits = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
        if rows <= EXPECTED_ROWS << (64 * agreeing // blocks):
            break
    return [sum(chosen) for chosen in combinations(bits, agreeing)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, rows: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect what distances of at most ``radius`` connect."""
    masks = block_masks(rows, radius)
    trees = F.array(*(F.struct(F.lit(i).alias("tree"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("shard"))
                      for i, m in enumerate(masks)))
    spread = distinct.select("fingerprint", F.explode(trees).alias("t")).select("fingerprint", "t.*")
    large = (spread.groupBy("tree", "shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS)
             .select("tree", "shard", F.ceil(F.col("n") / (SHARD_ROWS // 2)).alias("chunks")))
    own = F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("chunks"))
    cells = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
        lambda k: F.greatest(own, k) * F.col("chunks") + F.least(own, k)))
    placed = (spread.join(large, ["tree", "shard"], "left")
              .select("tree", "shard", F.explode(cells).alias("cell"), "fingerprint")
              .repartition("tree", "shard", "cell").sortWithinPartitions("tree", "shard", "cell"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(values: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            sides = [[], []]
            for group in np.split(values, starts[1:]):
                if len(group) > 1 and len(pairs := tree_links(group.view(np.uint64), radius)):
                    for side, at in zip(sides, pairs.T):
                        side.append(group[at])
            if sides[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s)) for s in sides], ["a", "b"])

        kept = np.zeros((4, 0), np.int64)  # the last group of a batch may go on in the next one
        for batch in batches:
            kept = np.concatenate([kept, np.stack([c.to_numpy() for c in batch.columns]).astype(np.int64)], axis=1)
            starts = np.concatenate([[0], np.nonzero((np.diff(kept[:3], axis=1) != 0).any(axis=0))[0] + 1])
            if len(starts) > 1:
                yield from found(kept[3, :starts[-1]], starts[:-1])
                kept = kept[:, starts[-1]:]
        if kept.shape[1]:
            yield from found(kept[3], np.zeros(1, np.int64))

    return placed.mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    k: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id): the smallest id that is reachable over links."""
    rows = written(fingerprints(docs, id_col, text_col, k), "fingerprints")
    distinct = written(rows.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "distinct")
    roots = written(component_roots(links(distinct.select("fingerprint"), distinct.count(), radius)), "roots")
    rooted = distinct.join(roots.withColumnRenamed("a", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fingerprint", "component_id")
    return rows.join(classes, "fingerprint").select(id_col, "fingerprint", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that represent their component, one row each; rows without an id all stay."""
    first = near_duplicates(docs, id_col, text_col, **options).where(F.col(id_col) == F.col("component_id"))
    kept = docs.join(first.select(id_col), id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)


def hex_digits(fingerprint_col: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fingerprint_col)), 16, "0"))
