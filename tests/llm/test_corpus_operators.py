"""Preferences, neighbours, near-duplicates, toxicity, mixing and the pipeline against plain versions, with odd rows."""

import importlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casetrail.llm import ann, chat, mixing, pii, queries, simhash, toxicity
from casetrail.llm.common import written
from casetrail.operators import components
from tests.compare import digest, duck, run_duck

from .conftest import invented
from .test_near_copies import plain_stay

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    names, want = run_duck(duck(SF), queries.ORACLES[name])
    assert sorted(names) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(names, want)[0]


# preferences

def test_preference_pairs(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "yes"), (0, 2, "user", "q2"), (0, 3, "assistant", "A"),
             (0, 4, "user", "bye"), (1, 0, "user", "z"), (1, 1, "assistant", "B <|im_end|>"),
             (2, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "assistant", "alone"),
             (6, 0, "user", "no reply"), (7, 0, "assistant", "x"), (None, 0, "assistant", "lost"),
             (8, None, None, None), (8, 1, "assistant", None), (9, 0, "assistant", "y"), (9, 0, "assistant", "y")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, pair string")
    got = {r["conv_id"]: r for r in rows_of(chat.format_pairs(chat.pairs_of_replies(df)))}
    assert sorted(got) == [0, 1, 2, 3, 8, 9]
    head = "<|im_start|>assistant\n"
    r = got[0]
    assert r["prompt_turns"] == 3 and r["prompt"] == (
        "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nq2<|im_end|>\n")
    assert r["chosen"] == head + "A<|im_end|>\n" and r["rejected"] == head + "B < |im_end|><|im_end|>\n"
    for side in ("chosen", "rejected"):
        (span,) = r[f"{side}_spans"]
        assert r[side][span["start"]:span["end"]] == r[side][len(head):-1]
    assert (got[2]["prompt_turns"], got[2]["chosen"], got[2]["rejected"], got[2]["chosen_spans"]) == (1, "", "", [])
    assert got[8]["prompt"] == "<|im_start|>\n<|im_end|>\n" and got[8]["rejected"] == head + "y<|im_end|>\n"
    assert got[9]["prompt_turns"] == 1
    assert rows_of(chat.format_pairs(chat.pairs_of_replies(df.limit(0)))) == []


def test_prefix_of_unequal_conversations(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [(1, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b"), ("user", "c")]),
            (2, [], [("assistant", "b")]), (3, [("user", "a"), ("assistant", "b")], [("user", "x"), ("assistant", "b")])]
    got = {r["i"]: r for r in rows_of(chat.format_pairs(spark.createDataFrame(
        rows, f"i int, chosen {turn}, rejected {turn}")))}
    assert [got[i]["prompt_turns"] for i in (1, 2, 3)] == [2, 0, 0]
    assert got[1]["chosen"] == "" and got[1]["rejected"].count("im_start") == 1 and got[1]["rejected_spans"] == []
    assert got[3]["chosen"].count("im_start") == 2


# neighbours

def brute_neighbours(rows, asks, k=10):
    rows = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, x in rows:
        if asks(q):
            out[q] = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in rows if i != q)[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_neighbours(spark, sf):
    path = f"/root/testdata/{sf}"
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute_neighbours(table, lambda q: q % 100 == 0)
    got = {}
    for r in rows_of(queries.op5_ann(spark, path)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, *_ in own] == list(range(1, len(want[q]) + 1))
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in want[q]})
    assert hits / sum(map(len, want.values())) >= 0.9


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_ROWS", 40)
    monkeypatch.setattr(ann, "LEAF_ROWS", 30)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    r = random.Random(2)
    good = [(i, [r.gauss(0, 1) for _ in range(12)]) for i in range(200)] + [(i, [1.0] * 12) for i in range(300, 500)]
    bad = [(0, [1.0] * 12), (900, None), (1000, []), (1001, [0.0] * 12), (1002, [math.nan] * 12), (1100, [math.inf] * 12),
           (1200, [1.0] * 11 + [None]), (1300, [1.0] * 5), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad[1:]], "vec_id long, embedding array<float>, id string, leaf int")
    got = {}
    for x in rows_of(ann.nearest(df, df.vec_id % 100 == 0, 10)):
        got.setdefault(x["query_id"], []).append((x["rank"], x["score"], x["id"]))
    want = brute_neighbours(good, lambda q: q % 100 == 0)
    assert set(got) == set(want)
    assert sorted(i for *_, i in got[300]) == list(range(301, 311)), "ties go to the smaller id"
    hits = sum(len({i for *_, i in got[q]} & {i for _, i in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    few = df.where("vec_id in (100, 1)")
    assert [(x["id"], x["rank"]) for x in rows_of(ann.nearest(few, few.vec_id % 100 == 0, 10))] == [(1, 1)]
    assert rows_of(ann.nearest(df.limit(0), df.vec_id % 100 == 0, 10)) == []


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 2) + 2 * math.log(0.05)) < 1e-6
    draws = (np.random.default_rng(1).standard_normal((200_000, 8)) ** 2).sum(axis=1)
    assert abs((draws <= ann.chi_square_quantile(0.98)).mean() - 0.98) < 0.002


# near-duplicates

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(ids))]


def test_near_duplicates_match_brute_force(spark, tiny):
    prints = [plain_fingerprint(t) for t in tiny.text]
    want = {(i, f"{p:016x}", c) for i, p, c in zip(tiny.doc_id, prints, plain_components(list(tiny.doc_id), prints))}
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(queries.op8_simhash(spark, SF))} == want


def test_near_duplicates_of_odd_rows(odd, odd_rows, nothing):
    ids, prints = [r[0] for r in odd_rows], [plain_fingerprint(r[1]) for r in odd_rows]
    want = Counter(zip(ids, prints, plain_components(ids, prints)))
    got = Counter((r["doc_id"], r["fingerprint"] & (2 ** 64 - 1), r["component_id"])
                  for r in rows_of(simhash.near_duplicates(odd)))
    assert got == want
    kept = simhash.one_of_each(odd)
    left = Counter(r["doc_id"] for r in rows_of(kept))
    assert kept.columns == odd.columns and left[None] == 2
    assert {i for i in left if i is not None} == {c for c in plain_components(ids, prints) if c is not None}
    assert all(n == 1 for i, n in left.items() if i is not None)
    assert rows_of(simhash.near_duplicates(nothing)) == [] and rows_of(simhash.one_of_each(nothing)) == []


@pytest.mark.parametrize("seed", range(6))
def test_vantage_point_tree_connects_what_distances_connect(seed):
    r = random.Random(seed)
    values = []
    for _ in range(12):
        center = r.getrandbits(64)
        values += [center ^ sum(1 << b for b in r.sample(range(64), r.randrange(9))) for _ in range(r.randrange(1, 90))]
    values = list(dict.fromkeys(values))
    want = plain_components(list(range(len(values))), values)
    for leaf in (2, 48):
        parent = list(range(len(values)))
        for i, j in simhash.tree_links(np.array(values, dtype=np.uint64), 4, leaf).tolist():
            parent[i] = j
        assert [min(k for k in range(len(values)) if parent[k] == parent[i]) for i in range(len(values))] == want


def test_large_shards_are_searched_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 12)
    r = random.Random(8)
    values = [v - (1 << 64) if v >> 63 else v for v in {(r.getrandbits(8) << 56) | r.getrandbits(9) for _ in range(300)}]
    unsigned = [v & (2 ** 64 - 1) for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), len(values))
    root = {r.a: r.root for r in components.component_roots(links).collect()}
    groups = Counter(root.get(v, v) for v in values)
    assert sorted(groups.values()) == sorted(Counter(plain_components(list(range(len(values))), unsigned)).values())


def test_every_link_shares_a_root_shard():
    r = random.Random(4)
    for rows in (100, 10 ** 8, 10 ** 11):
        masks = simhash.block_masks(rows)
        for _ in range(300):
            differ = sum(1 << b for b in r.sample(range(64), 4))
            assert any(m & differ == 0 for m in masks)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 400)] + [(1000 + i, 1000) for i in range(1, 300)] + [(7, 7), (5000, 4999)]
    random.Random(1).shuffle(links)
    roots = {r.a: r.root for r in components.component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 401)}, **{1000 + i: 1000 for i in range(1, 300)}, 5000: 4999}


# toxicity

def test_segments_are_those_of_the_definition():
    r = random.Random(6)
    for _ in range(200):
        scores = [r.choice([-3.0, -1.0, -0.5, 1.0, 2.0, 4.0]) for _ in range(r.randrange(25))]

        def split(a, b):
            """Maximal segments by the recursive definition."""
            spans = [(round(sum(scores[i:j]), 6), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not spans or max(spans)[0] <= 0:
                return []
            total, length, start = max(spans)
            i, j = -start, -start - length
            return [*split(a, i), (i, j, total), *split(j, b)]

        assert [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(scores)] == split(0, len(scores))


def test_held_out_toxicity(spark):
    got = {r["doc_id"]: r for r in rows_of(queries.op9_toxicity(spark, LARGER))}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    pairs = [(got[i]["predicted"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert sum(p == y for p, y in pairs) / len(pairs) > 0.92
    assert not any(p and not y for p, y in pairs)


def test_toxicity_of_odd_rows(spark, corpus, odd, odd_rows, nothing):
    toxic = "vile scorn"
    docs = [(i, f"{invented(i, 60)} {toxic if i % 3 == 0 else ''} {invented(900 + i, 60)}", "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(0, 300)] + [(None, 1, 1), (5, None, 0)],
                                   "doc_id long, toxic int, quality int")
    model = toxicity.learn(corpus(docs), labels)
    got = {r["doc_id"]: r for r in rows_of(toxicity.score(corpus(docs), model))}
    assert all((got[i]["score"] >= 0.3) == (i % 3 == 0) for i in range(300))
    span = got[3]["passages"][0]
    assert toxic in dict(d[:2] for d in docs)[3][span["start"]:span["end"]]
    assert {r["doc_id"] for r in rows_of(toxicity.below(corpus(docs), model, 0.3))} == {i for i in range(300) if i % 3}
    scores = rows_of(toxicity.score(odd, model))
    assert len(scores) == len(odd_rows) and all(0 <= r["score"] < 0.3 and r["passages"] == [] for r in scores)
    assert toxicity.below(odd, model, 0.3).columns == odd.columns
    assert rows_of(toxicity.score(nothing, toxicity.learn(nothing, labels))) == []
    unlabelled = toxicity.learn(odd, labels.limit(0))
    assert {r["score"] for r in rows_of(toxicity.score(odd, unlabelled))} == {0.5}


# mixing

def water_level(sizes, weights, share=1.5, repeat=2):
    """Targets by sharing again what is above, until nothing is."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / whole > repeat * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / whole
            return targets
        for i in full:
            targets[i] = float(repeat * sizes[i])
            left -= targets[i]
        open_ -= full
    return targets


def checked_mix(rows, source_rows, block):
    sizes = Counter()
    for s, n in source_rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip(order, water_level([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, target in want.items():
        # half a slot of rounding, and one short block that a part of a pass has or has not
        assert abs(taken[s] - target) <= 1.5 * block + 1e-6 * target
    return taken


def test_mix_of_odd_rows(corpus, odd, odd_rows, nothing):
    sizes = [(s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for _, t, _, s in odd_rows]
    first = rows_of(mixing.taken(odd, block=16, slots=64))
    assert Counter((r["id"], r["size"], r["source"]) for r in first) == Counter(
        (i, n, s) for (i, *_), (s, n) in zip(odd_rows, sizes))
    checked_mix(first, sizes, 16)
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(map(key, first)) == sorted(map(key, rows_of(mixing.taken(odd.repartition(5), block=16, slots=64))))
    assert rows_of(mixing.taken(nothing)) == [] and rows_of(mixing.mixed_documents(nothing)) == []
    empty = corpus([(1, None, "en", "a"), (2, "", "en", None)])
    assert [(r["taken"], r["target"]) for r in rows_of(mixing.taken(empty))] == [(0, 0.0)] * 2


def test_sources_smaller_than_a_block_meet_their_targets(corpus):
    """Sources whose target is twice their words get every word twice, however few there are."""
    small = {"a": 10, "d": 100, "g": 129, "j": 400, "m": 1, "p": 128}
    docs = [(i, invented(i, n), "en", s) for i, (s, n) in enumerate(small.items())]
    docs += [(100 + i, invented(i, 150), "en", s) for i, s in enumerate("bcefhiklnoqr" * 40)]
    got = rows_of(mixing.taken(corpus(docs)))
    checked_mix(got, [(s, len(t.split())) for _, t, _, s in docs], 128)
    assert {r["source"]: (r["target"], r["taken"]) for r in got if r["source"] in small} == {
        s: (2.0 * n, 2 * n) for s, n in small.items()}


def test_slots_over_a_quota_are_given_to_sources_left_short(corpus):
    """Many shards of few slots draw unevenly; every slot is filled once and every quota is met."""
    docs = corpus([(i, invented(i, 40), "en", f"s{i % 17:02}") for i in range(600)])
    rows = written(mixing.sized(docs), "rows")
    counts = mixing.shard_counts(mixing.source_targets(rows), block=16, slots=5)
    quotas = {r["sid"]: (r["quota"], r["blocks"]) for r in rows_of(counts)}
    drawn = Counter()
    for r in rows_of(counts):
        drawn[r["sid"]] += r["n"]
    assert any(drawn[s] != q for s, (q, _) in quotas.items())
    filled = rows_of(mixing.slot_blocks(counts))
    assert Counter(r["sid"] for r in filled) == Counter({s: q for s, (q, _) in quotas.items()})
    assert len({(r["shard"], r["drawn_for"], r["slot"]) for r in filled}) == len(filled)
    uses = Counter((r["sid"], r["block"]) for r in filled)
    assert all(quotas[s][0] // quotas[s][1] <= n <= -(-quotas[s][0] // quotas[s][1]) for (s, _), n in uses.items())


def test_mixed_texts_hold_what_is_taken(corpus):
    docs = [(i, invented(i, 30 + 11 * (i % 40)), "en", f"s{i % 5}") for i in range(200)]
    frame = corpus(docs)
    taken = {r["id"]: r for r in rows_of(mixing.taken(frame, block=16, slots=64))}
    mixed = mixing.mixed_documents(frame, block=16, slots=64)
    words, texts = Counter(), dict(d[:2] for d in docs)
    for r in rows_of(mixed):
        own = Counter(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and not own - Counter(texts[r["doc_id"]].split())
        words[r["doc_id"]] += sum(own.values())
    assert mixed.columns == frame.columns
    assert {i: words[i] for i in taken} == {i: r["taken"] for i, r in taken.items()}


def test_permutation_is_one(spark):
    for size in (1, 2, 3, 17, 100, 257):
        places = spark.range(size).select(mixing.permuted(
            F.col("id"), F.lit(size).cast("long"), F.lit(3).cast("long")).alias("p"))
        assert sorted(r.p for r in places.collect()) == list(range(size))


# pipeline

def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        seen[name] = (before, docs)
    before, after = seen["toxicity"]
    scores = rows_of(toxicity.score(before, toxicity.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))))
    assert {r.doc_id for r in after.collect()} == {r["doc_id"] for r in scores if r["score"] < pipeline.TOXIC}
    before, after = seen["simhash_near_dedup"]
    assert Counter(r.doc_id for r in after.collect()) == plain_stay(before.select("doc_id", "text").collect())
    before, after = seen["pii"]
    assert {(r.doc_id, r.text, r.n_chars) for r in after.collect()} == {
        (r.doc_id, t := pii.masked(r.text, pii.find_spans(r.text)), len(t)) for r in before.collect()}
    before, after = seen["mixing"]
    taken = {r["id"]: r["taken"] for r in rows_of(mixing.taken(before))}
    words = Counter()
    for r in after.collect():
        words[r.doc_id] += len(r.text.split())
    assert {i: words[i] for i in taken} == taken
    final = rows_of(pipeline.STAGES[-1][1](spark, docs, SF))
    assert Counter(r["doc_id"] for r in final) == Counter(r.doc_id for r in docs.collect())
    assert all(r["n_tokens"] > 0 for r in final)
