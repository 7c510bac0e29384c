"""Best-fit packing of tokenised documents into sequences, by vectors of residual capacities.

A piece takes its tokens, one document and its attention cost (the square of its length) from the bin it goes to. Pieces
come in falling length. Of the bins that hold a piece under every capacity the one with the least weighted ``norm`` of
what is left after it gets the piece, or the one with the least weighted ``dot`` product of its residual and the piece
(the tightest in the directions that the piece needs); ties go to the bin opened first; where none holds it a new one opens.

Pieces of one length are alike, so the whole corpus is packed by its histogram of lengths, at most one row for each token
of a sequence. Bins in one state are one run: all of them take what the first takes, which is the same as packing piece
by piece. The plan is therefore bounded by the capacities, not by the data: a bin of T tokens holds fewer than
``sqrt(2 T)`` different lengths, and each length splits at most two runs. Pieces find their place by their number among
the pieces of their length, which is a running number inside a task plus the sum of the tasks before it; no task holds
all pieces of a length, however many are alike.

Null and empty texts are one piece that holds the end mark only. Repeated rows, null and equal ids are packed row by row.
An empty table gives no pieces. Only the id and the text are read; an item's own columns travel in a struct, so that their
names cannot clash. Long texts are cut into words before the tokenizer sees them; no text is shortened.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CALL, SLICE_BYTES, TOGETHER, encoded, ragged, slices, written

TOKENS = 2048
RULES = ("norm", "dot")
#: words a worker remembers between batches
REMEMBERED = 1 << 19
_BEYOND = "\u0250"   # the first letter after the Latin ones
_POINTS = ".,;:!?"   # never of one token with the letter or number before them
_WORDS: dict = {}


def _for_plain_words(tokenizer: str):
    """(encoder of lower-case Latin words between spaces, whether each id closes a word), where the file lets one be made:
    it lowers letters, takes a run of letters as one part, and marks the ends of words. Latin letters are composed as they
    stand, and all but the dotted capital i have one lower-case letter."""
    from tokenizers import Tokenizer

    file = json.loads(tokenizer)
    steps = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
    split = [p.get("pattern", {}).get("Regex", "") for p in (file["pre_tokenizer"] or {}).get("pretokenizers", [])]
    end = file["model"].get("end_of_word_suffix")
    known = steps and set(steps) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in steps
    if not (known and split and "|[\\p{L}]+|" in split[0] and end):
        return None, None
    as_bytes = file["pre_tokenizer"]["pretokenizers"][1:]
    encoder = Tokenizer.from_str(json.dumps({**file, "normalizer": None, "pre_tokenizer": {
        "type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *as_bytes]}}))
    closes = np.zeros(max(file["model"]["vocab"].values()) + 1, bool)
    closes[[i for token, i in file["model"]["vocab"].items() if token.endswith(end)]] = True
    return encoder, closes


class _Words(dict):
    """Word to its number, with the ids of all words seen so far; unseen ones are encoded together."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.encoder, self.new = Tokenizer.from_str(tokenizer), []
        self.simple, self.closes = _for_plain_words(tokenizer)
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = at = len(self)
        return at

    def encode(self) -> None:
        """Ids of the words met since the last call: those of the word without its closing points, and of these."""
        if not self.new:
            return
        parts: dict[str, int] = {}
        place, cut = [], []
        for word in self.new:
            stem = word.rstrip(_POINTS)
            if stem and stem != word and stem[-1].isalnum():
                place += [parts.setdefault(stem, len(parts)), parts.setdefault(word[len(stem):], len(parts))]
                cut.append(2)
            else:
                place.append(parts.setdefault(word, len(parts)))
                cut.append(1)
        flat, sizes = self._encoded(list(parts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        ids, lengths = ragged(flat, offsets, np.array(place, np.int64))
        own = np.add.reduceat(lengths, np.concatenate([[0], np.cumsum(cut)[:-1]]))
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(own)])
        self.new = []

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [self.simple is not None and w.isalpha() and max(w) < _BEYOND and "\u0130" not in w for w in words]
        other = [w for w, p in zip(words, plain) if not p]
        own = [w.lower() for w, p in zip(words, plain) if p]
        flats, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(own), TOGETHER * CALL):
            texts = [" ".join(own[i:i + TOGETHER]) for i in range(at, min(at + TOGETHER * CALL, len(own)), TOGETHER)]
            for found in self.simple.encode_batch_fast(texts, add_special_tokens=False):
                ids = np.array(found.ids, np.int64)
                flats.append(ids)
                sizes.append(np.diff(np.flatnonzero(self.closes[ids]), prepend=-1))
        rest, rest_sizes = encoded(self.encoder, self.encoder, other)
        order = np.argsort(np.argsort(~np.array(plain, bool), kind="stable"), kind="stable")
        sizes = np.concatenate([*sizes, rest_sizes])
        flat, _ = ragged(np.concatenate([*flats, rest]), np.concatenate([[0], np.cumsum(sizes)]), order)
        return flat, sizes[order]

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
            self.flat, self.offsets = self.flat[:0], self.offsets[:1]


def token_ids(texts: list[str], tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, offsets of the texts). The tokenizer never joins what white space parts, so each word is encoded once
    for each worker and batch."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    if tokenizer not in _WORDS:
        _WORDS[tokenizer] = _Words(tokenizer)
    words = _WORDS[tokenizer]
    split = [t.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") for t in texts]
    counts = [len(s) for s in split]
    numbers = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
    words.encode()
    flat, lengths = ragged(words.flat, words.offsets, numbers)
    word_ends = np.concatenate([[0], np.cumsum(lengths)])
    offsets = word_ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    words.forget()
    return flat, offsets


def pieces(docs: DataFrame, tokenizer_file: str, tokens: int = TOKENS, end: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids, ids_crc32) of every document: its ids and the ``end`` mark, cut where longer than
    ``tokens``; the checksum is that of the ids as little-endian unsigned 32-bit numbers.

    The tokenizer's file is read on the driver and shipped with the job; its size is that of a vocabulary.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE_BYTES):
            flat, offsets = token_ids([t or "" for t in batch.column(1).to_pylist()], tokenizer.value)
            flat = np.insert(flat, offsets[1:], end).astype(np.int32)
            offsets = offsets + np.arange(len(offsets))
            counts = -(-np.diff(offsets) // tokens)
            row = np.repeat(np.arange(len(counts)), counts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = offsets[row] + number * tokens
            length = np.minimum(tokens, offsets[row + 1] - begin)
            words = memoryview(flat.astype("<u4").tobytes())
            sums = [zlib.crc32(words[4 * b:4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(flat)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(number * tokens),
                 pa.array(length), lists, pa.array(sums, pa.int64())],
                [id_col, "piece", "start", "length", "ids", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids array<int>, ids_crc32 long")


class _Bins:
    """Runs of bins in one state: what is left of each capacity, the first bin, how many, tokens used."""

    def __init__(self, capacities: np.ndarray):
        self.left = np.empty((64, len(capacities)))
        self.first, self.count, self.used = (np.empty(64, np.int64) for _ in range(3))
        self.runs = 0

    def add(self, left: np.ndarray, first: int, count: int, used: int) -> None:
        if count:
            if self.runs == len(self.first):
                for name in ("left", "first", "count", "used"):
                    held = getattr(self, name)
                    setattr(self, name, np.concatenate([held, np.empty_like(held)]))
            at, self.runs = self.runs, self.runs + 1
            self.left[at], self.first[at], self.count[at], self.used[at] = left, first, count, used


def plan(histogram: dict[int, int], capacities: tuple[int, int, int], weights: tuple[float, float, float],
         rule: str) -> tuple[np.ndarray, int]:
    """(placements, bins). A placement (length, rank, per_bin, first_bin, offset) gives the pieces of a length from
    number ``rank`` on to consecutive bins, ``per_bin`` to each, one behind the other from ``offset``."""
    whole, weight = np.array(capacities, float), np.array(weights, float)
    bins, placed, opened = _Bins(whole), [], 0

    def score(left: np.ndarray, need: np.ndarray) -> np.ndarray:
        return ((left - need) / whole) ** 2 @ weight if rule == "norm" else (left * need / whole ** 2) @ weight

    def chain(left: np.ndarray, need: np.ndarray, most: int, until: float) -> int:
        """How many pieces the first bin of a run takes before another of the run is the better place."""
        k = 1
        while k < most and (left - (k + 1) * need >= 0).all() and score(left - k * need, need) <= until:
            k += 1
        return k

    for length in sorted(histogram, reverse=True):
        need, rest, rank = np.array([length, 1.0, float(length) ** 2]), histogram[length], 0
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {capacities}")
        while rest:
            left = bins.left[:bins.runs]
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                worth = score(left[fits], need)
                best = fits[worth == worth.min()]
                at = int(best[np.argmin(bins.first[best])])
                state, first, count, used = left[at].copy(), int(bins.first[at]), int(bins.count[at]), int(bins.used[at])
                each = chain(state, need, rest, worth.min()) if count > 1 else 1
                last = bins.runs = bins.runs - 1   # the run is replaced by its parts
                for held in (bins.left, bins.first, bins.count, bins.used):
                    held[at] = held[last]
            else:
                state, first, used = whole.copy(), opened, 0
                each = chain(state, need, rest, np.inf)
                count = -(-rest // each)
                opened += count
            full, extra = min(count, rest // each), 0
            if full < count:
                extra = rest - full * each
            placed.append((length, rank, each, first, used))
            bins.add(state - each * need, first, full, used + each * length)
            if extra:
                bins.add(state - extra * need, first + full, 1, used + extra * length)
            bins.add(state, first + full + (extra > 0), count - full - (extra > 0), used)
            rest, rank = rest - full * each - extra, rank + full * each + extra
    return np.array(placed, np.int64).reshape(-1, 5), opened


def pack(items: DataFrame, length_col: str = "length", tokens: int = TOKENS, documents: int | None = None,
         cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
         rules: tuple[str, ...] = RULES) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``, under the capacities in tokens, documents and attention cost.

    Null capacities do not bind. Of several ``rules`` the one that needs the fewest bins is used.
    """
    capacities = (tokens, tokens if documents is None else documents, tokens * tokens if cost is None else cost)
    spark, schema = items.sparkSession, items.schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        part = TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column(0).to_numpy()
            order = np.argsort(length, kind="stable")
            _, first, counts = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(first, counts)
            nth += np.array([seen[n] for n in length.tolist()], np.int64)
            for n, c in zip(length[order][first].tolist(), counts.tolist()):
                seen[n] += c
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(length), part, np.int32)), pa.array(nth), batch.column(1)],
                ["length", "part", "nth", "item"])

    inner = schema.simpleString()
    own = items.select(F.col(length_col).cast("long").alias("length"), F.struct(*schema.names).alias("item"))
    numbered = written(own.mapInArrow(number, f"length long, part int, nth long, item {inner}"), "pieces")
    counts = numbered.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row per length: bounded by the capacity in tokens
    histogram = {r.length: r.n for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = min((plan(histogram, capacities, weights, r) for r in rules), key=lambda p: p[1])[0]
    placed = spark.sparkContext.broadcast(placed[np.lexsort((placed[:, 1], placed[:, 0]))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, ranks_in = placed.value, 1 << 44
        keys = runs[:, 0] * ranks_in + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (0, 1))
            run = runs[np.searchsorted(keys, length * ranks_in + rank, side="right") - 1]
            bin_, inside = np.divmod(rank - run[:, 1], run[:, 2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(run[:, 3] + bin_), pa.array(run[:, 4] + inside * length)],
                ["item", "sequence_id", "offset"])

    ranked = numbered.join(base, ["length", "part"]).select("length", (F.col("base") + F.col("nth")).alias("rank"), "item")
    out = ranked.mapInArrow(place, f"item {inner}, sequence_id long, offset long")
    return out.select(*[F.col("item").getField(n).alias(n) for n in schema.names], "sequence_id", "offset")
