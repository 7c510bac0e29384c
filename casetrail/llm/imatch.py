"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms of an inverse-document-frequency band, counted over all documents. Besides the whole lexicon
several random subsets of it are used, of falling density. For each of them a document keeps its distinct terms, sorts
and hashes them; the fingerprint lists the hashes. Two documents are as like as the share of equal hashes among
subsets that either of them has a term of: dense subsets tell copies, sparse ones survive edits.

The lexicon is sent to all tasks: a term of the band stands in at least one of ``RAREST`` documents, so the band has at
most ``RAREST`` times the mean number of distinct terms of a document, however many documents there are. A document
with fewer than ``FEWEST`` terms of the band falls back to all its terms. Equal texts have equal fingerprints; null and
empty texts have no terms: their hashes are empty, alike among themselves (1) and unlike all others (0).

The next document (by falling id, the first after the last) comes from one shuffle into ranges of ids; the first
document of each range is also sent to the range before. Ids order null last, equal ids by text; repeated rows follow
each other; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, shuffle_partitions

RAREST = 2_000
COMMONEST = 10
FEWEST = 4
#: (density as a power of one half, number of subsets)
SUBSETS = ((0, 1), (2, 2), (4, 6), (6, 16), (8, 24), (10, 16))
DENSITIES = [power for power, n in SUBSETS for _ in range(n)]
FLUSH = 400_000
NONE = "0" * 8
_EDGES = string.punctuation + "«»“”„…–—¿¡"
_LAST = -(2 ** 63)


def terms(text: str) -> set[str]:
    """Distinct lower-case words without punctuation at their edges."""
    found = {w.strip(_EDGES) for w in text.lower().split()}
    found.discard("")
    return found


def subsets_of(term: str) -> tuple[int, ...]:
    """The lexicon subsets that a term belongs to."""
    return tuple(k for k, power in enumerate(DENSITIES)
                 if xxhash.xxh64_intdigest(term, k + 1) >> (64 - power) == 0)


def lexicon(docs: DataFrame, text_col: str = "text", rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """(term, df) of the band: in at least 1 of ``rarest`` and at most 1 of ``commonest`` documents, and in two or more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                rows += 1
                seen.update(terms(text.as_py() or ""))
                if len(seen) > FLUSH:
                    yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())})
                    seen.clear()
        # white space is no term: its count is the number of documents
        yield pa.RecordBatch.from_pydict({"term": [" ", *seen], "n": [rows, *seen.values()]})

    counted = (docs.select(text_col).mapInArrow(count, "term string, n long").groupBy("term")
               .agg(F.sum("n").alias("df")))
    n = docs.count()
    return counted.where((F.col("term") != " ") & (F.col("df") >= max(2, n / rarest)) & (
        F.col("df") <= max(2, n / commonest)))


def fingerprint(text: str, known: dict[str, tuple[int, ...]]) -> str:
    """Hex hashes of the sorted distinct terms in every subset, one after another."""
    own = terms(text)
    kept = own & known.keys()
    if len(kept) < FEWEST:
        kept, known = own, {t: known.get(t) or subsets_of(t) for t in own}
    parts: list[list[str]] = [[] for _ in DENSITIES]
    for t in sorted(kept):
        for k in known[t]:
            parts[k].append(t)
    return "".join(f"{xxhash.xxh32_intdigest(' '.join(p)) or 1:08x}" if p else NONE for p in parts)


def likeness(a: str, b: str) -> float:
    """The share of equal hashes among subsets that either side has a term of; 1 for two sides without terms."""
    pairs = [(a[i:i + 8], b[i:i + 8]) for i in range(0, len(a), 8)]
    used = [x == y for x, y in pairs if x != NONE or y != NONE]
    return sum(used) / len(used) if used else 1.0


def shared_lexicon(docs: DataFrame, text_col: str = "text"):
    """The lexicon with the subsets of each term, for every task (bounded, see above)."""
    found = {row.term: subsets_of(row.term) for row in lexicon(docs, text_col).select("term").toLocalIterator()}
    return docs.sparkSession.sparkContext.broadcast(found)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text."""
    shared = shared_lexicon(docs, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(t.as_py() or "", shared.value) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], [id_col, "fingerprint"])

    return by_batch(docs.select(id_col, text_col), f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint string", run)


def in_id_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, bucket, head, id, text): ranges of falling ids, sorted, each with the first rows of the next as heads."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    key = F.coalesce("id", F.lit(_LAST))
    parts = shuffle_partitions(docs.sparkSession)
    cuts = sorted(set(rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)))
    bucket = F.size(F.filter(F.array(*(F.lit(int(c)) for c in cuts)), lambda c: c > key)) if cuts else F.lit(0)
    rows = rows.withColumn("key", key).withColumn("bucket", bucket.cast("int"))
    # one row per range reaches the driver
    heads = sorted((r.bucket, r.first) for r in rows.groupBy("bucket").agg(F.max("key").alias("first")).collect())
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}
    own = rows.withColumn("head", F.lit(False))
    if before:
        to = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("key")]
        first = rows.where(F.col("key").isin(*before)).withColumn("bucket", to).withColumn("head", F.lit(True))
        own = own.unionByName(first)
    return own.repartitionByRange(max(1, len(heads)), "bucket").sortWithinPartitions(
        "bucket", "head", F.desc("key"), F.asc_nulls_first("text")).select("bucket", "head", "id", "text")


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near it is to that and to the next document."""
    shared = shared_lexicon(docs, text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting = shared.value, None
        for batch in batches:
            out = []
            for bucket, head, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if waiting and waiting[0] != bucket:
                    waiting = None
                own = "" if head and not waiting else fingerprint(text, known)
                if waiting:
                    _, last, before, mark = waiting
                    changed = edited(before, text)
                    new = fingerprint(changed, known)
                    out.append((last, len(before), hashlib.sha256(changed.encode()).hexdigest(), mark, new,
                                likeness(mark, new), likeness(mark, own)))
                waiting = None if head else (bucket, key, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    ordered = in_id_order(docs, id_col, text_col)
    return ordered.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                       "edited_fingerprint string, near_edited double, near_next double")
