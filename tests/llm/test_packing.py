"""Best-fit packing against packing piece by piece and against the tokenizer on whole texts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casetrail.llm import packing, queries

FILE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def whole_ids(texts):
    encoder = Tokenizer.from_file(FILE)
    return [encoder.encode(t or "", add_special_tokens=False).ids for t in texts]


def piece_by_piece(lengths, capacities, weights, rule):
    """Contents of the bins, each piece placed on its own."""
    bins, whole, w = [], np.array(capacities, float), np.array(weights)
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n], float)
        best = None
        for i, (left, _) in enumerate(bins):
            if (left >= need).all():
                worth = (((left - need) / whole) ** 2 @ w) if rule == "norm" else (left * need / whole ** 2) @ w
                if best is None or worth < best[0]:
                    best = (worth, i)
        if best is None:
            bins.append((whole - need, [n]))
        else:
            left, own = bins[best[1]]
            bins[best[1]] = (left - need, [*own, n])
    return Counter(tuple(own) for _, own in bins)


def bins_of(lengths, capacities, weights, rule):
    """Contents of the bins of the plan, in the order of their offsets."""
    placed, opened = packing.plan(Counter(lengths), capacities, weights, rule)
    bins, ranks = defaultdict(list), Counter(lengths)
    for n in ranks:
        runs = placed[placed[:, 0] == n]
        runs = runs[np.argsort(runs[:, 1])]
        for r in range(ranks[n]):
            _, rank, each, first, offset = runs[np.searchsorted(runs[:, 1], r, side="right") - 1].tolist()
            bins[first + (r - rank) // each].append((offset + (r - rank) % each * n, n))
    assert len(bins) == opened
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
    return Counter(tuple(n for _, n in sorted(own)) for own in bins.values())


@pytest.mark.parametrize("rule", packing.RULES)
@pytest.mark.parametrize("capacities", [(100, 100, 10_000), (100, 4, 10_000), (100, 100, 3_000), (100, 6, 4_000)])
def test_plan_is_packing_piece_by_piece(rule, capacities):
    for seed in range(6):
        r = random.Random(seed)
        most = int(capacities[2] ** 0.5)
        lengths = [min(most, max(1, int(r.expovariate(1 / 20)))) for _ in range(400)] + [7] * 150 * (seed % 2) + [most] * 9
        weights = (1.0, 0.3, 0.2)
        got = bins_of(lengths, capacities, weights, rule)
        assert got == piece_by_piece(lengths, capacities, weights, rule)
        for own in got:
            assert sum(own) <= capacities[0] and len(own) <= capacities[1] and sum(n * n for n in own) <= capacities[2]


def check_pieces(texts, rows):
    """``rows`` hold every token of ``texts`` (key to text) once, in sequences without gaps."""
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    ids = dict(zip(texts, whole_ids(texts.values())))
    assert set(by_doc) == set(texts)
    for key, own in by_doc.items():
        want = np.array([*ids[key], 0], "<u4")
        assert [r["piece"] for r in sorted(own, key=lambda r: r["start"])] == list(range(-(-len(want) // 2048)))
        for r in own:
            part = want[r["start"]:r["start"] + r["length"]]
            assert r["start"] == 2048 * r["piece"] and len(part) == r["length"] == min(2048, len(want) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    check_sequences(rows)
    total = sum(r["length"] for r in rows)
    return len({r["sequence_id"] for r in rows}), -(-total // 2048)


def check_sequences(rows, tokens=2048):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= tokens


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [r.asDict() for r in queries.op11_packing(spark, SF).collect()]
    used, least = check_pieces({r.doc_id: r.text for r in docs}, rows)
    assert used <= least * 1.02 + 1


def test_odd_texts_are_encoded_as_a_whole(corpus, odd_rows):
    texts = ["<|endoftext|> x<|startoftext|>y", "ΣΑΣ ΟΔΟΣ Σ", "é ́e  ̈", "a b c\x1cd\x85e", "İ I ﬁ ＡＢ",
             "don't we'll  it 's", "日本語 テスト", "x" * 5000, "\x00 a\x00b", *(t for _, t, _, _ in odd_rows)]
    own = corpus([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = defaultdict(list)
    for r in packing.pieces(own, FILE).collect():
        got[r.doc_id].append((r.piece, list(r.ids)))
    want = [[*ids, 0] for ids in whole_ids(texts)]
    assert [[t for _, ids in sorted(got[i]) for t in ids] for i in range(len(texts))] == want


def test_odd_rows(odd, odd_rows, nothing):
    got = packing.pack(packing.pieces(odd, FILE)).collect()
    check_sequences([r.asDict() for r in got])
    starts = Counter((r.doc_id, r.start) for r in got)
    assert sum(starts.values()) == sum(-(-(len(i) + 1) // 2048) for i in whole_ids([t for _, t, _, _ in odd_rows]))
    assert packing.pack(packing.pieces(nothing, FILE)).collect() == []


def test_alike_pieces_over_many_tasks_and_binding_capacities(spark):
    """A third of the pieces have one length; three documents and a cost bind before the tokens do."""
    r = random.Random(4)
    rows = [(i, 500 if i % 3 == 0 else r.randint(1, 900), "x", 0) for i in range(6000)]
    items = spark.createDataFrame(rows, "k long, length long, item string, part int").repartition(13)
    got = packing.pack(items, documents=3, cost=1_000_000).collect()
    assert sorted(x.k for x in got) == list(range(6000)) and got[0].item == "x"
    check_sequences([x.asDict() for x in got])
    held = defaultdict(list)
    for x in got:
        held[x.sequence_id].append(x.length)
    assert all(len(v) <= 3 and sum(n * n for n in v) <= 1_000_000 for v in held.values())
    want = min(sum(piece_by_piece([n for _, n, _, _ in rows], (2048, 3, 1_000_000), (1.0, 0.1, 0.1), rule).values())
               for rule in packing.RULES)
    assert len(held) == want


def test_a_piece_beyond_the_capacities_is_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 3000)], "k long, length long"))
