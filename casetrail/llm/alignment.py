"""Alignment of the tokens of two tokenizers by lockstep merging of their byte ends.

Documents are cut into units: a word and the single space before it, where both sides of the space are no white space.
Neither tokenizer has tokens across such a place, so every unit is encoded once for each worker and batch, and unit ends
are ends of tokens in both. A batch lays the byte ends of all documents in two flat arrays, in lanes of ``LANE`` units (a
long document has many). One NumPy state vector holds the A and B pointer of each lane. Every step emits one link for each
lane and a cut where both tokens end together, moves the pointer of the token that ends first (both at a cut), and drops
the lanes that are finished. Steps are therefore bounded by the longest lane, whatever the documents.

Counts of id pairs are summed inside documents, inside tasks, then over the corpus. Pairs that hold more than 1/``FREQUENT``
of all links (fewer than ``FREQUENT``, whatever the corpus) are looked up in the tasks; the others meet their counts in a
shuffle where no pair is frequent. The best count of each B id is one row per id of its vocabulary.

Null and empty texts and texts that one of the tokenizers does not give back byte by byte have no tokens. Repeated rows
count each; null and equal ids are kept row by row. An empty table gives none. Only the id and the text are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, by_batch, encoded, ragged, slices, written

LANE = 256
FREQUENT = 1 << 16
REMEMBERED = 1 << 17
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_UNITS: dict = {}


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else the next free one."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + n): b for n, b in enumerate(others)}}


class _Side:
    """One tokenizer's ids and token ends of the units seen so far."""

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = token_bytes
        self.widths = np.array([len(t) for t in token_bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        self.flat, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Stores the ids of new units; returns the bytes of each."""
        self.flat = np.concatenate([self.flat, flat])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        text = b"".join(map(self.bytes.__getitem__, flat.tolist()))
        ends = np.concatenate([[0], np.cumsum(self.widths[flat])])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [text[s:e] for s, e in zip(ends, ends[1:])]


class _Units(dict):
    """Unit to its number; both sides' tokens of every number, and whether they give the unit back."""

    def __init__(self, a_model: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        self.a_encoder = Tokenizer.from_str(a_model)
        self.a_encoder.encode_special_tokens = True
        self.a_parting = Tokenizer.from_str(a_model)   # reads the special token that parts units
        letters = byte_letters()
        entries = {i: t for t, i in self.a_encoder.get_vocab(with_added_tokens=True).items()}
        size = max(entries) + 1
        self.a = _Side([bytes(letters.get(c, 63) for c in entries.get(i, "")) for i in range(size)])
        self.b_encoder = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b_encoder.id_to_piece(i) for i in range(self.b_encoder.get_piece_size())]
        self.b = _Side([bytes([int(p[3:5], 16)]) if self.b_encoder.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)])
        self.whole, self.new = np.zeros(0, bool), []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = at = len(self)
        return at

    def encode(self) -> None:
        if self.new:
            spaced = [" " + u for u in self.new]
            a = self.a.learn(*encoded(self.a_parting, self.a_encoder, spaced))
            b_ids = self.b_encoder.encode(self.new, num_threads=1)
            b_sizes = np.array([len(i) for i in b_ids], np.int64)
            b = self.b.learn(np.fromiter((t for i in b_ids for t in i), np.int64, b_sizes.sum()), b_sizes)
            want = [s.encode() for s in spaced]
            same = [x == y == w for x, y, w in zip(a, b, want)]
            self.whole, self.new = np.concatenate([self.whole, np.array(same, bool)]), []

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
            self.a.forget()
            self.b.forget()
            self.whole = self.whole[:0]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_lanes: np.ndarray, b_lanes: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A tokens, B tokens) of all links and (A tokens, B tokens) of all cuts.

    Lane i holds the A tokens from ``a_lanes[i]`` to ``a_lanes[i + 1]`` and likewise for B; its last tokens end together.
    """
    a, b, stop = a_lanes[:-1].copy(), b_lanes[:-1].copy(), a_lanes[1:].copy()
    link_a, link_b, cut_a, cut_b = ([np.zeros(0, np.int64)] for _ in range(4))
    while len(a):
        end_a, end_b = a_ends[a], b_ends[b]
        cut = end_a == end_b
        link_a.append(a)
        link_b.append(b)
        cut_a.append(a[cut])
        cut_b.append(b[cut])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return np.concatenate(link_a), np.concatenate(link_b), np.sort(np.concatenate(cut_a)), np.sort(np.concatenate(cut_b))


def _aligned(texts: list[str], units: _Units) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(flat values, offsets of the texts) of every list that :func:`align` returns."""
    own = [list(map(units.__getitem__, _BETWEEN.split(t))) if t else [] for t in texts]
    units.encode()
    counts = np.array([len(u) for u in own], np.int64)
    numbers = np.fromiter((n for u in own for n in u), np.int64, counts.sum())
    text_of = np.repeat(np.arange(len(own)), counts)
    broken = np.zeros(len(own), bool)
    broken[text_of[~units.whole[numbers]]] = True
    numbers, text_of = numbers[~broken[text_of]], text_of[~broken[text_of]]
    first = np.searchsorted(text_of, np.arange(len(own)))   # first unit of each text
    lane = np.flatnonzero((np.arange(len(numbers)) - first[text_of]) % LANE == 0)
    sides, out, tokens_of = {}, {}, {}
    for name, side in (("a", units.a), ("b", units.b)):
        ids, lengths = ragged(side.flat, side.offsets, numbers)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        sides[name] = (np.cumsum(side.widths[ids]), np.append(ends[lane], ends[-1]))
        tokens_of[name] = np.repeat(text_of, lengths)
        out[f"{name}_ids"] = (ids, ends[np.append(first, len(numbers))])
    link_a, link_b, cut_a, cut_b = lockstep(sides["a"][0], sides["b"][0], sides["a"][1], sides["b"][1])
    order = np.argsort(link_a, kind="stable")
    link_a, link_b, texts_at = link_a[order], link_b[order], np.arange(len(own) + 1)
    for name, at, of in (("a_cuts", cut_a, "a"), ("b_cuts", cut_b, "b"), ("link_a", link_a, "a"), ("link_b", link_b, "b")):
        base = out[f"{of}_ids"][1][tokens_of[of][at]]
        ends = name.endswith("cuts")   # a cut is given as the number of tokens up to it
        out[name] = (at - base + ends, np.searchsorted(tokens_of[of][at], texts_at))
    width = len(units.b.bytes)
    pair = out["a_ids"][0][link_a] * width + out["b_ids"][0][link_b]
    most = len(units.a.bytes) * width
    keys, times = np.unique(tokens_of["a"][link_a] * most + pair, return_counts=True)
    out["pairs"] = (keys % most, np.searchsorted(keys // most, texts_at))
    out["times"] = (times, out["pairs"][1])
    return out


def vocabulary_sizes(a_file: str, b_file: str) -> tuple[int, int]:
    """Numbers of ids of both tokenizers."""
    import sentencepiece

    with open(a_file, encoding="utf-8") as f:
        model = json.load(f)
    ids = [*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]
    return max(ids) + 1, sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text",
          finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """The tokens of both tokenizers, their groups and their links, for every document.

    ``a_ids``, ``b_ids``: token ids; ``a_cuts``, ``b_cuts``: tokens up to the end of each group; ``link_a``, ``link_b``:
    places of the tokens of each link; ``pairs``, ``times``: its distinct id pairs (a * size of B + b) and their links.
    A is a ``tokenizers`` file of a byte-level vocabulary, B a ``sentencepiece`` model that puts a space in front.
    Where only digests of these lists are wanted, ``finish`` makes them, with ``schema``, before the lists leave the task.
    """
    context = docs.sparkSession.sparkContext
    with open(a_file, encoding="utf-8") as f, open(b_file, "rb") as g:
        models = context.broadcast((f.read(), g.read()))
    kind = dict(docs.dtypes)[id_col]
    names = ("a_ids", "b_ids", "a_cuts", "b_cuts", "link_a", "link_b", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = tuple(map(hash, models.value))
        if key not in _UNITS:
            _UNITS[key] = _Units(*models.value)
        units = _UNITS[key]
        for batch in slices(batches, 1, SLICE_BYTES):
            found = _aligned(batch.column(1).to_pylist(), units)
            units.forget()

            def lists(name: str, kind=np.int32) -> pa.Array:
                values, offsets = found[name]
                return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))

            aligned = pa.RecordBatch.from_arrays(
                [batch.column(0), *map(lists, names), lists("pairs", np.int64)], [id_col, *names, "pairs"])
            yield finish(aligned) if finish else aligned

    whole = ", ".join([f"`{id_col}` {kind}", *(f"{n} array<int>" for n in names), "pairs array<long>"])
    return docs.select(id_col, text_col).mapInArrow(run, schema or whole)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): links of every id pair in the corpus; ``best`` where no pair of its B id has more."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs, place = np.unique(batch.column(0).flatten().to_numpy(), return_inverse=True)
        sums = np.bincount(place, weights=batch.column(1).flatten().to_numpy(), minlength=len(pairs))
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums.astype(np.int64))], ["pair", "n"])

    parts = by_batch(aligned.select("pairs", "times"), "pair long, n long", run)
    counts = written(parts.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b = F.pmod("pair", F.lit(b_size))
    best = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))   # one row per id of B
    return counts.withColumn("b", b).join(F.broadcast(best), "b").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, b_size: int, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``aligned`` with ``n_best`` (links whose count is the best of their B id) and ``count_sum``."""
    spark = aligned.sparkSession
    row = written(aligned.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("own"), "pairs", "times"),
                  "aligned")
    counts = written(pair_counts(row, b_size), "counts")
    links = counts.agg(F.sum("count").alias("n")).first().n or 0
    common = F.col("count") * FREQUENT > links
    frequent = counts.where(common).orderBy("pair").toPandas()   # fewer than FREQUENT rows
    known = spark.sparkContext.broadcast(tuple(frequent[c].to_numpy(np.int64) for c in ("pair", "count", "best")))

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, count, best = known.value
        lists = batch.column(1)
        pairs, times = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (1, 2))
        lengths = lists.value_lengths().fill_null(0).to_numpy()
        at = np.repeat(np.arange(batch.num_rows), lengths)
        place = np.searchsorted(keys, pairs)
        found = place < len(keys)
        found[found] = keys[place[found]] == pairs[found]
        t, p, of = times[found], place[found], at[found]
        sums = np.zeros((2, batch.num_rows), np.int64)
        np.add.at(sums[0], of, t * best[p])
        np.add.at(sums[1], of, t * count[p])
        rows, rare = batch.column(0), ~found
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([rows, rows.take(pa.array(at[rare]))]),
             pa.concat_arrays([pa.array(sums[0]), pa.nulls(int(rare.sum()), pa.int64())]),
             pa.concat_arrays([pa.array(sums[1]), pa.nulls(int(rare.sum()), pa.int64())]),
             pa.concat_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.array(pairs[rare])]),
             pa.concat_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.array(times[rare])])],
            ["row", "n_best", "count_sum", "pair", "times"])

    parts = written(by_batch(row.select("row", "pairs", "times"), (
        "row long, n_best long, count_sum long, pair long, times long"), split), "parts")
    rare = parts.where("pair is not null").select("row", "pair", "times").join(counts.where(~common), "pair").select(
        "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
        (F.col("times") * F.col("count")).alias("count_sum"))
    sums = parts.where("pair is null").select("row", "n_best", "count_sum").unionByName(rare)
    own = row.select("row", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "own")
    sums = sums.withColumn("own", F.lit(None).cast(row.schema["own"].dataType))
    return own.unionByName(sums).groupBy("row").agg(
        F.first("own", ignorenulls=True).alias("own"), F.sum("n_best").alias("n_best"),
        F.sum("count_sum").alias("count_sum")).select("own.*", "n_best", "count_sum")


def group_texts(a_ids: pa.Array, b_ids: pa.Array, a_cuts: pa.Array, b_cuts: pa.Array, sizes: tuple[int, int]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3``: the ids of every group, for each row."""
    rows = len(a_ids)
    flat = [x.flatten().to_numpy().astype(np.int64) for x in (a_ids, b_ids, a_cuts, b_cuts)]
    at = [np.concatenate([[0], np.cumsum(x.value_lengths().fill_null(0).to_numpy())]) for x in (a_ids, b_ids, a_cuts)]
    groups_of = np.repeat(np.arange(rows), np.diff(at[2]))
    a_ends, b_ends = flat[2] + at[0][groups_of], flat[3] + at[1][groups_of]   # over all rows
    a_number, b_number = np.arange(len(flat[0])), np.arange(len(flat[1]))
    a_group, b_group = np.searchsorted(a_ends, a_number, side="right"), np.searchsorted(b_ends, b_number, side="right")
    b_before = np.concatenate([[0], b_ends])
    out = np.empty(len(flat[0]) + len(flat[1]), np.int64)
    size_a, size_b = sizes
    last_a, last_b = ((n + 1 == ends[g]).astype(np.int64) for n, ends, g in (
        (a_number, a_ends, a_group), (b_number, b_ends, b_group)))
    last_b[at[1][1:][np.diff(at[1]) > 0] - 1] = 2
    out[a_number + b_before[a_group]] = flat[0] + size_a * last_a
    out[b_number + a_ends[b_group]] = 2 * size_a + flat[1] + size_b * last_b
    words = _words(size_a, size_b)
    begin = at[0] + at[1]
    return [b"".join(map(words.__getitem__, out[s:e].tolist())) for s, e in zip(begin, begin[1:])]


_TEXTS: dict = {}


def _words(size_a: int, size_b: int) -> list[bytes]:
    """An id of either side with what follows it: within a group, at the end of its side, at the end of the text."""
    if (size_a, size_b) not in _TEXTS:
        a, b = ([b"%d" % i for i in range(n)] for n in (size_a, size_b))
        _TEXTS[size_a, size_b] = [x + end for side, ends in ((a, (b",", b"|")), (b, (b",", b";", b"")))
                                  for end in ends for x in side]
    return _TEXTS[size_a, size_b]
