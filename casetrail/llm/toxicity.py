"""Toxicity by maximum-scoring segments.

Learning: the log-odds of a token between toxic and clean texts, with a Dirichlet prior whose mean is the token's
frequency over all documents (Monroe, Colaresi and Quinn 2008), counted once per text and token; the beginnings of
words are tokens as well, so that inflected and compound forms share their evidence. Tokens whose log-odds
are significant keep them as scores, all others share a small negative drift, so that a random text drifts downwards.

Scoring: one linear scan finds every maximal-scoring segment (Ruzzo and Tompa 1999). Extreme-value theory calibrates a
segment: in ``n`` tokens of clean text a score of ``S`` or more is expected at most ``n * exp(-lambda * S)`` times, with
``lambda`` the root of E[exp(lambda * s)] = 1 over the clean distribution (Karlin and Altschul 1990). A document adds
up the evidence of its significant segments, and a logistic curve maps that to a probability.

The labelled sample is bounded (``MAX_LABELLED`` texts, chosen by a hash of the id); of near copies in it one counts. The
prior is counted over all documents. Labels without a match, null labels and null ids teach nothing. Null and empty texts
have no segments and get the score of no evidence; repeated rows are scored each; without any labelled text of
both classes every document gets the share of toxic labels (0.5 without labels at all).
"""

from __future__ import annotations

import math
import re
import string
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch

MAX_LABELLED = 20_000
PRIOR_WEIGHT = 200.0
LEAST_Z = 4.0
DRIFT = 0.01
MAX_SCORE = 8.0
LEAST_EVIDENCE = 0.0
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)
PREFIXES = range(4, 9)
MEMO = 100_000
_EDGES = string.punctuation + "«»“”„…–—¿¡"


def tokens(text: str) -> list[str]:
    """Lower-case words without punctuation at their edges."""
    return [w.strip(_EDGES) for w in text.lower().split()]


def features(word: str) -> list[str]:
    """A word and its beginnings (inflected and compound words share them), most specific first."""
    return [word, *(f"{word[:n]}*" for n in reversed(PREFIXES) if len(word) > n)]


def training_row(id_col: str = "doc_id") -> Column:
    """Whether the labels of a document may be learnt from: three quarters of them, by a checksum of the id."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0  # lambda
    slope: float = 0.0
    offset: float = 0.0
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def of(self, words: list[str]) -> list[float]:
        """Scores of tokens: that of the most specific known feature, else the drift."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = next((self.scores[f] for f in features(w) if f in self.scores), -DRIFT)
        return [memo[w] for w in words]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score), left to right, in linear time."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at the end, nearest with less before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, left, total, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def toxic_segments(text: str, model: Model) -> list[tuple[int, int, float, float]]:
    """(first token, end token, score, evidence) of the segments that chance explains less than ``exp(-evidence)`` times."""
    scores = model.of(tokens(text))
    if max(scores, default=0.0) <= 0:
        return []
    found = ((a, b, s, s * model.decay - math.log(len(scores))) for a, b, s in maximal_segments(scores))
    return [segment for segment in found if segment[3] > LEAST_EVIDENCE]


def _passages(text: str, segments: list[tuple[int, int, float, float]]) -> list[dict]:
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    return [{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "evidence": e} for a, b, s, e in segments]


def _near_keys(words: list[str]) -> list[int]:
    """Min-hashes of three-word shingles: near copies share at least one of them."""
    hashes = np.array([hash(tuple(words[i:i + 3])) for i in range(max(1, len(words) - 2))], dtype=np.int64)
    mixed = hashes.astype(np.uint64)[:, None] * _ODD
    return (mixed ^ (mixed >> np.uint64(29))).min(axis=0).astype(np.int64).tolist()


def _one_of_near_copies(rows: Iterator) -> list[tuple[int, list[str]]]:
    """(label, words) of the first row of every group that shares min-hashes; the rows are the bounded sample."""
    owner: dict[tuple[int, int], int] = {}
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for n, row in enumerate(rows):
        parent.append(n)
        for key in enumerate(row.keys):
            a, b = root(owner.setdefault(key, n)), root(n)
            parent[max(a, b)] = min(a, b)
        kept.append((row.label, [sys.intern(w) for w in row.words]))
    return [pair for n, pair in enumerate(kept) if root(n) == n]


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """The bounded sample: min-hashes, label and distinct tokens of its texts."""
    ids = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & training_row(id_col))
           .groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
           .orderBy(F.xxhash64(id_col), id_col).limit(MAX_LABELLED))

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [tokens(t.as_py()) for t in batch.column(0)]
        keys = pa.array([_near_keys(w) for w in words], pa.list_(pa.int64()))
        sets = pa.array([sorted(set(w) - {""}) for w in words], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([keys, batch.column(1), sets], ["keys", "label", "words"])

    # the ids of the sample are bounded by MAX_LABELLED, so they may go to every task
    texts = docs.join(F.broadcast(ids), id_col).where(F.col("_text").isNotNull()).select("_text", "_label")
    return by_batch(texts, "keys array<long>, label int, words array<string>", keyed)


def _prior(docs: DataFrame, known: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each known feature stands, and the number of all (document, word) pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, index, memo = Counter(), 0, shared.value, {}
        for batch in batches:
            for text in batch.column(0):
                words = set(tokens(text.as_py() or ""))
                total += len(words)
                if len(memo) > MEMO:
                    memo.clear()
                for w in words.difference(memo):
                    memo[w] = tuple(f for f in features(w) if f in index)
                seen.update({f for w in words for f in memo[w]})
        keys = [-1, *(index[w] for w in seen)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total, *seen.values()], pa.int64())],
                                         ["token", "n"])

    sums = docs.select("_text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out, pairs = np.zeros(len(known)), 0
    for row in sums.toLocalIterator():
        if row.token < 0:
            pairs = row.n
        else:
            out[row.token] = row.n
    return out, pairs


def _decay(scores: np.ndarray, chance: np.ndarray) -> float:
    """The positive root of E[exp(x * s)] = 1, the rest of the chance at the drift."""
    rest = max(0.0, 1.0 - chance.sum())
    low, high = 0.0, 20.0
    for _ in range(80):
        x = (low + high) / 2
        if (chance * np.exp(x * scores)).sum() + rest * math.exp(-x * DRIFT) < 1:
            low = x
        else:
            high = x
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small ridge."""
    design, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2),
                               design.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _evidence(segments: list[tuple[int, int, float, float]]) -> float:
    """What a document adds up: the logarithm of one plus the evidence, so that long documents stay comparable."""
    return math.log1p(sum(e for *_, e in segments))


def _fit(words: list[str], sample: list[tuple[int, list[str]]], y: np.ndarray, t: np.ndarray, c: np.ndarray,
         a: np.ndarray) -> Model:
    """Scores from counts in toxic and clean texts and their prior; decay; calibration over the sample."""
    n_t, n_c = (sum(len(own) for label, own in sample if label == k) + PRIOR_WEIGHT for k in (1, 0))
    odds = np.log((t + a) / (n_t - t - a)) - np.log((c + a) / (n_c - c - a))
    z = odds / np.sqrt(1 / (t + a) + 1 / (c + a))
    # the variance of a token that clean texts never show is mostly that of the prior: then the count decides
    strong = (z >= LEAST_Z) | ((c == 0) & (t * math.log(n_c / n_t + 1) >= LEAST_Z * 3))
    keep = np.where(strong | (z <= -LEAST_Z))[0]
    scores = np.clip(odds[keep], -MAX_SCORE, MAX_SCORE)
    known = {words[i]: float(s) for i, s in zip(keep, scores)}
    model = Model(known, _decay(scores, (c[keep] + a[keep]) / n_c))
    x = np.array([_evidence(toxic_segments(" ".join(own), model)) for _, own in sample])
    model.slope, model.offset = _logistic(x, y)
    return model


def _probability(segments: list[tuple[int, int, float, float]], model: Model) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * _evidence(segments) + model.offset))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    """Token scores, decay and calibration; driver memory is bounded by the labelled sample."""
    docs = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    sample = _one_of_near_copies(_labelled(docs, labels, id_col, label_col).toLocalIterator())
    y = np.array([label for label, _ in sample], dtype=float)
    share = float(y.mean()) if len(y) else 0.5
    rough = min(max(share, 1e-6), 1 - 1e-6)
    flat = Model(offset=math.log(rough / (1 - rough)))
    if not 0 < share < 1:
        return flat
    toxic, clean = Counter(), Counter()
    for label, words in sample:
        if label:
            toxic.update({f for w in words for f in features(w)})
    known = {w: i for i, w in enumerate(sorted(w for w, n in toxic.items() if n > 1))}
    for label, words in sample:
        if not label:
            clean.update({f for w in words for f in features(w) if f in known})
    if not known:
        return flat
    seen, pairs = _prior(docs, known)
    t, c = (np.array([n[w] for w in known], dtype=float) for n in (toxic, clean))
    return _fit(list(known), sample, y, t, c, PRIOR_WEIGHT * (seen + 0.01) / max(pairs, 1))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages): the probability of being toxic, and every significant passage in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                               ("evidence", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, scores, passages = shared.value, [], []
        for text in (t.as_py() or "" for t in batch.column(1)):
            found = toxic_segments(text, m)
            scores.append(_probability(found, m))
            passages.append(_passages(text, found) if found else [])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)],
            [id_col, "score", "passages"])

    schema = (f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, "
              "passages array<struct<start:long,end:long,score:double,evidence:double>>")
    return by_batch(docs.select(id_col, text_col), schema, run)


def below(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose probability of being toxic is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = (t.as_py() or "" for t in batch.column(at))
        return batch.filter(pa.array([_probability(toxic_segments(t, shared.value), shared.value) < threshold
                                      for t in texts], pa.bool_()))

    return by_batch(docs, docs.schema, run)
