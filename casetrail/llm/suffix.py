"""Removal of repeated byte strings by the common-prefix interval tree of an enhanced suffix array.

A byte goes if a string of ``least`` bytes over it also starts earlier: in a document with a smaller id, or earlier in the
same one. A suffix array over a whole corpus is one global sort of every byte, so the array is built sparsely, over the
suffixes that can start a maximal repeat, in five steps that Spark partitions:

1. *Anchors.* In every window of ``least`` bytes the ``GRAM`` bytes with the smallest hash are an anchor (about one byte in
   37). Equal windows choose equal anchors, so two copies of a string share an anchor at the same place in both. An
   anchor's context, the bytes that a window over it can reach, is described by a hash.
2. *Classes.* Anchors meet by hash. Occurrences with equal contexts are copies of their first one: all they can reach goes.
   Only the first one of each context, and only where one anchor has several contexts, needs its bytes.
3. *Contexts.* Those bytes are cut from the documents.
4. *Enhanced suffix array.* Per group of contexts the suffixes that start where left contexts part are sorted; the
   lengths of common prefixes are scanned with a stack, which walks the tree of intervals; an interval of ``least`` or
   more whose left neighbours differ is a maximal repeat group, with all its occurrences, not just neighbouring ones.
   All but the earliest occurrence go.
5. *Removal.* Per document the spans are merged and the other bytes kept.

Steps meet in buckets of bounded bytes (``BUCKET_BYTES`` of text each); a task first drops repeated contexts of its own
batch, so a passage that a third of all documents share reaches its bucket once per batch and context.

Null texts are empty. Rows that agree in id and text are one document (each gets its result); rows that share an id only
order by a hash of the text; null ids order first. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

LEAST = 100
GRAM = 28
BUCKET_BYTES = 16 << 20
PIECE = 1 << 18
SUFFIXES = 20_000
CANDIDATES = 300_000
NO_ID = -(2 ** 63)

_PLACE = np.uint64((1 << 20) - 1)
_U = np.uint64
_M1, _M2, _M3 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(11).integers(1, 2 ** 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {}

_PACKED = "bucket long, kind int, h binary, ctx binary, id binary, th binary, a binary, b binary"
_COLUMNS = ["bucket", "kind", "h", "ctx", "id", "th", "a", "b"]
_TYPES = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32)
ANCHORS, SPANS, NEEDS = 0, 1, 2
_NONE = np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _M1
    return (x ^ (x >> _U(29))) * _M2


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse modulo 2**64."""
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(int(_PLACE) + 2, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _sliding(fn, values: np.ndarray, width: int) -> np.ndarray:
    """``fn`` (minimum or maximum) over every window of ``width``, by doubling."""
    out, reach = values, 1
    while 2 * reach <= width:
        out, reach = fn(out[:-reach], out[reach:]), 2 * reach
    return fn(out[:reach - width], out[width - reach:]) if width > reach else out


def _chunk_anchors(pieces: list[tuple[int, int, bytes, int, int]], least: int) -> np.ndarray:
    """Anchors of concatenated pieces (doc, length of the doc, bytes, offset in the doc, first window):
    columns h, ctx, doc, place in the doc, reach to the left and right."""
    up, down = _powers()
    data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
    n, windows = len(data), len(data) - least + 1
    if windows < 1:
        return np.zeros((6, 0), np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:n], out=sums[1:])
    h = _mix((sums[GRAM:] - sums[:-GRAM]) * down[:n - GRAM + 1])
    order = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    offsets = np.cumsum([0, *(len(p[2]) for p in pieces)])
    valid = np.zeros(windows + 1, np.int8)
    for (_, _, raw, at, first), start in zip(pieces, offsets.tolist()):
        low, high = start + first, min(start + len(raw) - least + 1, start + first + PIECE)
        if low < high:
            valid[low] += 1
            valid[high] -= 1
    width = least - GRAM + 1
    lowest = np.where(np.cumsum(valid[:-1]) > 0, _sliding(np.minimum, order, width), _U(0))
    pad = np.zeros(width - 1, np.uint64)
    q = np.nonzero(_sliding(np.maximum, np.concatenate([pad, lowest, pad]), width) == order)[0]
    own = np.searchsorted(offsets, q, side="right") - 1
    docs, lengths, at = (np.array([p[i] for p in pieces], np.int64)[own] for i in (0, 1, 3))
    place = at + q - offsets[own]
    left, right = np.minimum(least - GRAM, place), np.minimum(least, lengths - place)
    ctx = (sums[q + right] - sums[q - left]) * down[q - left]
    ctx = _mix(ctx + left.astype(np.uint64) * _M3 + right.astype(np.uint64) * _M2)
    return np.stack([h[q], ctx, *(x.astype(np.uint64) for x in (docs, place, left, right))])


def _pieces(doc: int, raw: bytes, least: int) -> Iterator[tuple[int, int, bytes, int, int]]:
    """A text in pieces whose windows follow each other, with all bytes that their contexts reach."""
    if len(raw) <= PIECE:
        yield doc, len(raw), raw, 0, 0
        return
    for first in range(0, len(raw) - least + 1, PIECE):
        start = max(0, first - least)
        yield doc, len(raw), raw[start:first + PIECE + 3 * least], start, first - start


def _pack(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows of one bucket each, with packed columns."""
    order = np.argsort(bucket, kind="stable")
    sorted_buckets = bucket[order]
    cuts = np.nonzero(np.diff(sorted_buckets))[0] + 1
    columns = [c[order].astype(t) if len(c) else c for c, t in zip(columns, _TYPES)]  # spans have no hashes
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        if b > a:
            yield (int(sorted_buckets[a]), kind, *(c[a:b].tobytes() for c in columns))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
    columns = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _COLUMNS)


def _unpack(table: pa.Table, kind: int) -> list[np.ndarray]:
    rows = [r for r, k in enumerate(table.column("kind").to_pylist()) if k == kind]
    out = []
    for name, t in zip(_COLUMNS[2:], _TYPES):
        column = table.column(name)
        out.append(np.frombuffer(b"".join(column[r].as_py() for r in rows), dtype=t))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, th, text): th, a hash of the text, orders rows that share an id."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.select("id", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("key"),
                       F.xxhash64("text").alias("th"), "text")


def _anchor_rows(rows: DataFrame, buckets: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            found, waiting, size = [], [], 0
            for doc, text in enumerate(batch.column(2)):
                for piece in _pieces(doc, text.as_py().encode(), least):
                    waiting.append(piece)
                    size += len(piece[2])
                    if size >= PIECE:
                        found.append(_chunk_anchors(waiting, least))
                        waiting, size = [], 0
            found.append(_chunk_anchors(waiting, least) if waiting else np.zeros((6, 0), np.uint64))
            h, ctx, doc, place, left, right = np.concatenate(found, axis=1)
            if not len(h):
                continue
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((ths, ids))] = np.arange(len(ids))
            doc, place, left, right = (x.astype(np.int64) for x in (doc, place, left, right))
            # rows that repeat id and text are one document: they share the rank of the first
            same = np.lexsort((ths, ids))
            again = np.concatenate([[False], (np.diff(ids[same]) == 0) & (np.diff(ths[same]) == 0)])
            rank[same] = np.maximum.accumulate(np.where(again, 0, np.arange(len(ids))))
            where = rank[doc] << 32 | place
            whole = _mix(h * _M3 + ctx)
            order = np.lexsort((where, whole))
            whole, where = whole[order], where[order]
            first = np.concatenate([[True], whole[1:] != whole[:-1]])
            twice = np.concatenate([[False], ~first[1:] & (where[1:] == where[:-1])])
            lead = where[np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))]
            later = order[~first & ~twice & (where != lead)]
            order = order[first]
            out = list(_pack((h[order] % _U(buckets)).astype(np.int64), ANCHORS, h[order], ctx[order], ids[doc[order]],
                             ths[doc[order]], place[order], left[order] << 8 | right[order]))
            if len(later):
                d, p = doc[later], place[later]
                out += _pack(np.mod(ids[d], buckets), SPANS, _NONE, _NONE, ids[d], ths[d],
                             p - left[later], p + right[later])
            yield _batch(out)

    return rows.select("key", "th", "text").mapInArrow(run, _PACKED)


def _classes(buckets: int):
    """Step 2 for one bucket: spans of repeated contexts, and the contexts whose bytes are needed."""
    def run(table: pa.Table) -> pa.Table:
        out = [tuple(r[c] for c in _COLUMNS) for r in table.to_pylist() if r["kind"] == SPANS]
        h, ctx, ids, ths, place, reach = _unpack(table, ANCHORS)
        if len(h):
            _, where, n = np.unique(h, return_inverse=True, return_counts=True)
            keep = np.nonzero(n[where] > 1)[0]
            keep = keep[np.lexsort((place[keep], ths[keep], ids[keep], ctx[keep], h[keep]))]
            h, ctx, ids, ths, place, reach = (x[keep] for x in (h, ctx, ids, ths, place, reach))
        if len(h):
            group = np.concatenate([[True], h[1:] != h[:-1]])
            first = group | np.concatenate([[True], ctx[1:] != ctx[:-1]])
            lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            itself = (ids == ids[lead]) & (ths == ths[lead]) & (place == place[lead])
            later = np.nonzero(~first & ~itself)[0]
            if len(later):
                start, end = place[later] - (reach[later] >> 8), place[later] + (reach[later] & 255)
                out += _pack(np.mod(ids[later], buckets), SPANS, _NONE, _NONE, ids[later], ths[later], start, end)
            several = np.bincount(np.cumsum(group) - 1, weights=first) > 1
            need = np.nonzero(first & several[np.cumsum(group) - 1])[0]
            if len(need):
                out += _pack(np.mod(ids[need], buckets), NEEDS, h[need], ctx[need], ids[need], ths[need], place[need],
                             reach[need])
        return pa.Table.from_batches([_batch(out)])

    return run


def _contexts(buckets: int, least: int):
    """Step 3 for one bucket of documents: the bytes around each needed anchor, packed by the anchor's bucket."""
    span = 2 * least - GRAM

    def run(docs: pa.Table, needs: pa.Table) -> pa.Table:
        h, _, ids, ths, place, reach = _unpack(needs, NEEDS)
        rows = []
        if len(h):
            texts = {(i, t): text for i, t, text in zip(*(docs.column(c).to_pylist() for c in ("key", "th", "text")))}
            order = np.lexsort((place, ths, ids))
            h, ids, ths, place, reach = (x[order] for x in (h, ids, ths, place, reach))
            cuts = np.nonzero((np.diff(ids) != 0) | (np.diff(ths) != 0))[0] + 1
            bytes_of = np.zeros((len(h), span), np.uint8)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)]):
                raw = np.frombuffer(texts[int(ids[a]), int(ths[a])].encode(), np.uint8)
                at = place[a:b, None].astype(np.int64) + np.arange(-(least - GRAM), least)
                inside = (at >= 0) & (at < len(raw))
                bytes_of[a:b] = np.where(inside, raw[np.clip(at, 0, len(raw) - 1)], 0)
            bucket = (h % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.nonzero(np.diff(bucket[order]))[0] + 1
            for part in np.split(order, cuts):
                rows.append((int(bucket[part[0]]), NEEDS, h[part].tobytes(), bytes_of[part].tobytes(),
                             ids[part].tobytes(), ths[part].tobytes(), place[part].tobytes(), reach[part].tobytes()))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _common(rows: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbouring rows; 0 before the first."""
    differ = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])])


def _sorted_rows(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The tree of intervals (length, first, last) of common prefixes of ``least`` or more, by one scan with a stack."""
    stack = [(0, 0)]
    for i in range(1, len(common) + 1):
        length, start = common[i] if i < len(common) else 0, i - 1
        while stack[-1][0] > length:
            deep, start = stack.pop()
            if deep >= least:
                yield deep, start, i - 1
        if stack[-1][0] < length:
            stack.append((length, start))


def repeats(around: np.ndarray, h: np.ndarray, ids: np.ndarray, ths: np.ndarray, place: np.ndarray, left: np.ndarray,
            right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of all but the earliest occurrence in every maximal repeat group of the contexts.

    ``around`` has the bytes around each anchor; contexts of one hash form a group. Suffixes start where two left contexts
    of the group part, since a maximal repeat cannot start anywhere else.
    """
    back = least - GRAM
    head = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    best = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for side, reach in ((around[:, back:], right), (around[:, :back][:, ::-1], left)):
        rows = np.concatenate([head, side], axis=1)
        order = _sorted_rows(rows)
        common = _common(rows[order]) - 8
        common[1:] = np.minimum(common[1:], np.minimum(reach[order][1:], reach[order][:-1]))
        most = np.maximum(common, np.append(common[1:], -1))
        at = np.empty(len(order), np.int64)
        at[order] = most
        best.append(at)
        parts.append((order, common))
    group_of = np.unique(h, return_inverse=True)[1]
    order, common = parts[1]
    inner = common >= 0
    inner[0] = False
    # (group, length of a common left context): where suffixes may start
    starts = np.unique(np.stack([group_of[order][inner], common[inner]], axis=1), axis=0)
    first = np.searchsorted(starts[:, 0], np.arange(group_of.max() + 2))
    n = (first[1:] - first[:-1])[group_of]
    by_group = np.argsort(group_of, kind="stable")
    groups = np.append(np.nonzero(np.diff(group_of[by_group]))[0] + 1, len(h))
    load = np.cumsum(n[by_group])
    found: list[list[np.ndarray]] = [[], [], []]
    at = 0
    while at < len(h):
        # whole groups, so many that their candidates stay bounded
        limit = np.searchsorted(load, (load[at - 1] if at else 0) + CANDIDATES)
        to = groups[min(np.searchsorted(groups, max(limit, at + 1)), len(groups) - 1)]
        members = by_group[at:to]
        at = to
        own = n[members]
        who = np.repeat(members, own)
        offset = np.arange(len(who)) - np.repeat(np.cumsum(own) - own, own)
        back_by = starts[first[:-1][group_of[who]] + offset, 1]
        fits = (back_by <= best[1][who]) & (back_by + best[0][who] >= least)
        for side, x in zip(found, _group_repeats(
                who[fits], back_by[fits], around, h, ids, ths, place, left, right, least)):
            side.append(x)
    return tuple(np.concatenate(x) for x in found)


def _group_repeats(who: np.ndarray, back_by: np.ndarray, around: np.ndarray, h: np.ndarray, ids: np.ndarray,
                   ths: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray,
                   least: int) -> tuple[np.ndarray, ...]:
    """Spans in whole groups; candidates are suffixes that start ``back_by`` bytes before the anchor of ``who``."""
    if not len(who):
        return (np.zeros(0, np.int64),) * 3
    back, width = least - GRAM, 2 * least - GRAM
    some, who = np.unique(who, return_inverse=True)
    around, h, ids, ths, place, left, right = (x[some] for x in (around, h, ids, ths, place, left, right))
    # all spans of a context hold its anchor, so what they cover is one span
    low_end, high_end = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), -1)
    padded = np.zeros((len(h), width + back), np.uint8)
    padded[:, :width] = around
    windows = np.lib.stride_tricks.sliding_window_view(padded.ravel(), width)
    # only suffixes that share their first bytes with others of the group can be in an interval: one class for each
    key = np.empty(len(who), np.uint64)
    for at in range(0, len(who), SUFFIXES):
        w, o = who[at:at + SUFFIXES], back_by[at:at + SUFFIXES]
        part = windows[w * (width + back) + back - o][:, :least]
        key[at:at + SUFFIXES] = _mix((_TABLE[part] * _powers()[0][:least]).sum(axis=1, dtype=np.uint64) + _mix(h[w]))
    order = np.argsort(key, kind="stable")
    who, back_by, key = who[order], back_by[order], key[order]
    starts = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1])
    sizes = np.diff(np.append(starts, len(who)))
    before = np.where(back_by < left[who], around[who, np.maximum(back - back_by - 1, 0)].astype(np.int64), -1)
    low, high = np.minimum.reduceat(before, starts), np.maximum.reduceat(before, starts)
    # where no left neighbour differs, the repeat starts further to the left
    extends = (low >= 0) & (low == high) & (
        np.minimum.reduceat(back_by, starts) == np.maximum.reduceat(back_by, starts))
    keep = np.repeat((sizes > 1) & ~extends, sizes)
    who, back_by, before, key = who[keep], back_by[keep], before[keep], key[keep]
    ends = np.append(np.nonzero(np.diff(key))[0] + 1, len(who))
    at = 0
    while at < len(who):
        # whole classes, so many that their bytes stay bounded
        to = ends[min(np.searchsorted(ends, at + SUFFIXES), len(ends) - 1)]
        w, o, b = who[at:to], back_by[at:to], before[at:to]
        rows = np.concatenate([key[at:to].astype(">u8").view(np.uint8).reshape(-1, 8),
                               windows[w * (width + back) + back - o]], axis=1)
        at = to
        order = _sorted_rows(rows)
        w, o, b, rows = w[order], o[order], b[order], rows[order]
        common = _common(rows) - 8
        size = o + right[w]
        common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
        start = place[w] - o
        cuts = np.append(np.nonzero(common < least)[0], len(w))
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if last - first < 2:
                continue
            for length, i, j in intervals(common[first:last].tolist(), least):
                s = slice(first + i, first + j + 1)
                known = b[s]
                if known[0] >= 0 and (known == known[0]).all() and (o[s] == o[s][0]).all():
                    continue
                earliest = np.lexsort((start[s], ths[w[s]], ids[w[s]]))[0]
                same = (ids[w[s]] == ids[w[s]][earliest]) & (ths[w[s]] == ths[w[s]][earliest]) & (
                    start[s] == start[s][earliest])
                np.minimum.at(low_end, w[s][~same], start[s][~same])
                np.maximum.at(high_end, w[s][~same], start[s][~same] + length)
    hit = np.nonzero(high_end >= 0)[0]
    return some[hit], low_end[hit], high_end[hit]


def _repeated(buckets: int, least: int):
    """Step 4 for one bucket: spans of the later occurrences in maximal repeat groups."""
    def run(table: pa.Table) -> pa.Table:
        h, ids, ths, place, reach = (x for i, x in enumerate(_unpack_needs(table)) if i != 1)
        around = _unpack_needs(table)[1].reshape(len(h), 2 * least - GRAM)
        rows = []
        if len(h):
            who, start, end = repeats(around, h, ids, ths, place.astype(np.int64), (reach >> 8).astype(np.int64),
                                      (reach & 255).astype(np.int64), least)
            if len(who):
                rows = list(_pack(np.mod(ids[who], buckets), SPANS, _NONE, _NONE, ids[who], ths[who], start, end))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _unpack_needs(table: pa.Table) -> list[np.ndarray]:
    kinds = (np.uint64, np.uint8, *_TYPES[2:])
    return [np.frombuffer(b"".join(x.as_py() for x in table.column(c)), t) for c, t in zip(_COLUMNS[2:], kinds)]


def _removed(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Step 5 for one bucket of documents: merged spans and the other bytes."""
    _, _, ids, ths, start, end = _unpack(spans, SPANS)
    order = np.lexsort((start, ths, ids))
    ids, ths, start, end = (x[order] for x in (ids, ths, start, end))
    cuts = np.nonzero((np.diff(ids) != 0) | (np.diff(ths) != 0))[0] + 1
    merged = {}
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
        if b > a:
            high = np.maximum.accumulate(end[a:b])
            new = np.concatenate([[True], start[a + 1:b] > high[:-1]])
            last = np.append(np.nonzero(new)[0][1:] - 1, b - a - 1)
            merged[int(ids[a]), int(ths[a])] = list(zip(start[a:b][new].tolist(), high[last].tolist()))
    sizes, found, kept = [], [], []
    for key, th, text in zip(*(docs.column(c).to_pylist() for c in ("key", "th", "text"))):
        raw, own = text.encode(), merged.get((key, th), [])
        edges = [0, *(x for span in own for x in span), len(raw)]
        kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        sizes.append(len(raw))
        found.append([{"start": a, "end": b} for a, b in own])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.Table.from_arrays([docs.column("id"), pa.array(sizes, pa.int64()), pa.array(found, kind),
                                 pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])


def without_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, removed, kept) of every row: the removed byte spans and the bytes that are left."""
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(spark), size // BUCKET_BYTES) | 1
    matches = written(_anchor_rows(rows, buckets, least).groupBy("bucket").applyInArrow(_classes(buckets), _PACKED),
                      "matches")
    placed = rows.withColumn("bucket", F.pmod("key", F.lit(buckets))).select("bucket", "id", "key", "th", "text")
    needs = matches.where(f"kind = {NEEDS}")
    around = placed.groupBy("bucket").cogroup(needs.groupBy("bucket")).applyInArrow(_contexts(buckets, least), _PACKED)
    more = around.groupBy("bucket").applyInArrow(_repeated(buckets, least), _PACKED)
    spans = matches.where(f"kind = {SPANS}").unionByName(more)
    kind = dict(docs.dtypes)[id_col]
    return placed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(
        _removed, f"id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
