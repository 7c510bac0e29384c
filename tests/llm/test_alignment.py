"""Cross-tokenizer alignment against a plain one that encodes whole texts and compares all byte ranges."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from casetrail.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def plain_tokens(text, a, b, letters):
    """(A ids, A ends, B ids, B ends) of a text, or None where it has no tokens."""
    if not text:
        return None
    want = (" " + text).encode()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, b.id_to_piece(i)) for i in b_ids)]
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return None
    return a_ids, np.cumsum([len(t) for t in a_bytes]).tolist(), b_ids, np.cumsum([len(t) for t in b_bytes]).tolist()


def plain(rows):
    """The contract's columns for (id, text) rows."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    found, counts = [], Counter()
    for i, text in rows:
        tokens = plain_tokens(text, a, b, letters)
        if tokens is None:
            found.append((i, [], [], [], ""))
            continue
        a_ids, a_ends, b_ids, b_ends = tokens
        links = []
        starts = [0, *b_ends[:-1]]
        low = 0
        for x, (s, e) in zip(a_ids, zip([0, *a_ends], a_ends)):
            while b_ends[low] <= s:
                low += 1
            k = low
            while k < len(b_ids) and starts[k] < e:
                links.append((x, b_ids[k]))
                k += 1
        counts.update(links)
        both = sorted(set(a_ends) & set(b_ends))
        a_at, b_at = ([0, *(bisect_right(ends, e) for e in both)] for ends in (a_ends, b_ends))
        groups = [",".join(map(str, a_ids[a_at[k]:a_at[k + 1]])) + "|" + ",".join(map(str, b_ids[b_at[k]:b_at[k + 1]]))
                  for k in range(len(both))]
        found.append((i, a_ids, b_ids, links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), c in counts.items():
        best[y] = max(best[y], c)
    return Counter((i, len(x), len(y), len(g.split(";")) if g else 0, len(links), sum(counts[p] == best[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
                   for i, x, y, links, g in found)


def columns(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                   for r in df.collect())


def of_rows(spark, monkeypatch, frame, frequent=None, lane=None):
    if frequent:
        monkeypatch.setattr(alignment, "FREQUENT", frequent)
    if lane:
        monkeypatch.setattr(alignment, "LANE", lane)
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    return columns(queries.op13_alignment(spark, ""))


ODD = ["<|endoftext|> plain <s> </s> <unk>", " leading", "trailing ", "two  spaces   three", "line\nbreak \n and\ttab \x1c x",
       "a▁b under", "no break ﬁ ＡＢ é ́", "日本語のテスト 混ぜる text", "😀😀 👩‍👩‍👧 flags 🇩🇪", "\x00nul \x00", "x" * 3000, "é" * 700,
       "   ", "\n", "'s 'll don't", "1234567890 12 3 4,5.6", "▁", "Ünïcödé ß ẞ"]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert columns(queries.op13_alignment(spark, SF)) == plain([(r.doc_id, r.text) for r in docs])


def test_odd_rows(spark, monkeypatch, odd, odd_rows, corpus, nothing):
    rows = [*odd_rows, *((500 + i, t, "en", "s") for i, t in enumerate(ODD)), (500, ODD[0], "en", "s")]
    want = plain([r[:2] for r in rows])
    assert of_rows(spark, monkeypatch, corpus(rows)) == want
    # no pair is frequent, and lanes of three units
    assert of_rows(spark, monkeypatch, corpus(rows), frequent=1, lane=3) == want
    assert of_rows(spark, monkeypatch, nothing) == Counter()


def test_links_and_cuts_of_random_ends():
    r = random.Random(9)
    for _ in range(200):
        a_ends, b_ends, a_lanes, b_lanes, want, cuts = [], [], [0], [0], [], []
        for _ in range(r.randint(0, 6)):
            size = r.randint(1, 40)
            own = [sorted({*r.sample(range(1, size + 1), r.randint(1, size)), size}) for _ in "ab"]
            for i, x in enumerate(own[0]):
                for j, y in enumerate(own[1]):
                    begin = [o[k - 1] if k else 0 for o, k in zip(own, (i, j))]
                    if max(begin) < min(x, y):
                        want.append((len(a_ends) + i, len(b_ends) + j))
                    if x == y:
                        cuts.append((len(a_ends) + i, len(b_ends) + j))
            a_ends, b_ends = a_ends + own[0], b_ends + own[1]
            a_lanes.append(len(a_ends))
            b_lanes.append(len(b_ends))
        found = alignment.lockstep(*(np.array(x, np.int64) for x in (a_ends, b_ends, a_lanes, b_lanes)))
        assert sorted(zip(*(x.tolist() for x in found[:2]))) == sorted(want)
        assert list(zip(*(x.tolist() for x in found[2:]))) == cuts


def test_operator_returns_places_of_tokens(spark, corpus):
    text = "An unbelievable example of tokenisation, indeed"
    (row,) = alignment.align(corpus([(1, text, "en", "s")]), A, B).collect()
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a_ids, a_ends, b_ids, b_ends = plain_tokens(text, a, b, alignment.byte_letters())
    assert (row.a_ids, row.b_ids) == (a_ids, b_ids)
    both = sorted(set(a_ends) & set(b_ends))
    assert row.a_cuts == [a_ends.index(e) + 1 for e in both] and row.b_cuts == [b_ends.index(e) + 1 for e in both]
    want = [(i, j) for i, e in enumerate(a_ends) for j, f in enumerate(b_ends)
            if max([0, *a_ends][i], [0, *b_ends][j]) < min(e, f)]
    assert list(zip(row.link_a, row.link_b)) == want
