"""Byte-level BPE encoding and decoding with a local rank file.

The merges run in the ``tiktoken`` library. A long text is cut beforehand where no match of the splitting pattern can
reach across: between a character that is not white space and a space. Every pattern that consumes visible characters
stops before white space and looks at nothing behind it, so both halves encode as they would in one piece, and memory
is bounded by a chunk plus the ids of one text. Decoding joins raw bytes, so ids of half a character are no error.

Null and empty texts have no ids; repeated rows are encoded each; an empty table gives an empty table; only the id and
text columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch

CHUNK_CHARS = 1 << 18
_SAFE = re.compile(r"(?<=\S)(?= )")
_ENCODERS: dict = {}


def _encoder(ranks: bytes, pattern: str):
    """One encoder per worker process and rank file."""
    key = (hash(ranks), pattern)
    if key not in _ENCODERS:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _ENCODERS[key]


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """The text in pieces of at least ``size`` characters that end at safe boundaries."""
    cuts, at = [0], 0
    while len(text) - at > size and (found := _SAFE.search(text, at + size)):
        cuts.append(at := found.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _read(rank_file: str) -> bytes:
    with open(rank_file, "rb") as f:
        return f.read()


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) of every whole text, without special tokens.

    The rank file is read on the driver and shipped with the job (its size is that of a vocabulary, not of the data).
    """
    ranks = docs.sparkSession.sparkContext.broadcast(_read(rank_file))
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode_one = _encoder(ranks.value, pattern).encode_to_numpy
        ids, offsets = [], [0]
        for text in batch.column(1):
            parts = [encode_one(c, disallowed_special=()) for c in safe_chunks(text.as_py() or "") if c]
            ids += parts
            offsets.append(offsets[-1] + sum(map(len, parts)))
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "token_ids"])

    return by_batch(docs.select(id_col, text_col), f"`{id_col}` {kind}, token_ids array<int>", run)


def decode(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, token_ids, decoded binary): the raw bytes of the ids; null ids decode to no bytes."""
    ranks = tokens.sparkSession.sparkContext.broadcast(_read(rank_file))
    kind = dict(tokens.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode_one = _encoder(ranks.value, pattern).decode_bytes
        raw = [decode_one(ids.values.to_pylist() if ids.is_valid else []) for ids in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(raw, pa.binary())], [id_col, "token_ids", "decoded"])

    return by_batch(
        tokens.select(id_col, "token_ids"), f"`{id_col}` {kind}, token_ids array<int>, decoded binary", run)
