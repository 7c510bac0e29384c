"""Sharding, repeats, personal data, tokens and fingerprints against plain versions, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from casetrail.llm import bpe, imatch, pii, queries, sharding, suffix

from .conftest import invented

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# sharding

def checked_shards(rows, expected, shards):
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in expected)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) <= set(range(shards))
    return sizes


def test_shards_hold_all_rows_in_near_equal_bytes(spark, tiny):
    rows = rows_of(queries.op1_sharding(spark, SF).withColumnRenamed("doc_id", "id"))
    sizes = checked_shards(rows, tiny.itertuples(index=False, name=None), 24)
    largest = max(r["size"] for r in rows)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= largest


@pytest.mark.parametrize("ids", ["null", "equal rows"])
def test_rows_without_an_id_of_their_own_are_cut(corpus, ids):
    rows = [(None if ids == "null" else 7, invented(1 if ids == "equal rows" else i, 60), "en", "s") for i in range(960)]
    got = rows_of(sharding.shards(sharding.measured(corpus(rows)), 8))
    sizes = checked_shards(got, [r[:2] for r in rows], 8)
    largest = max(r["size"] for r in got)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 6 * largest


def test_shards_of_odd_rows(odd, odd_rows, nothing):
    first = rows_of(sharding.shards(sharding.measured(odd), 5))
    checked_shards(first, [r[:2] for r in odd_rows], 5)
    again = rows_of(sharding.shards(sharding.measured(odd.repartition(7)), 5))
    key = lambda r: tuple(str(r[c]) for c in ("id", "size", "text_crc32", "shard", "slot"))
    assert sorted(map(key, first)) == sorted(map(key, again))
    by_target = rows_of(sharding.shards(sharding.measured(odd), target_bytes=100_000))
    assert len({r["shard"] for r in by_target}) > 1
    assert rows_of(sharding.shards(sharding.measured(nothing), 5)) == []


# repeats

def brute_removed(rows, least):
    """(n_bytes, removed spans, kept) per row, by a set of all strings of ``least`` bytes."""
    seen, out, results = set(), {}, []
    for _, th, text in sorted({(i if i is not None else suffix.NO_ID, th, t) for i, th, t in rows}):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - least + 1):
            if raw[s:s + least] in seen:
                gone[s:s + least] = b"\x01" * least
            seen.add(raw[s:s + least])
        out[text, th, _] = gone
    for i, th, text in rows:
        gone = out[text, th, i if i is not None else suffix.NO_ID]
        spans = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(gone))]
        results.append((i, len(text.encode()), tuple(spans), bytes(x for x, g in zip(text.encode(), gone) if not g)))
    return sorted(results, key=str)


def removed(df, least):
    return sorted(((r["id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["removed"]), bytes(r["kept"]))
                   for r in rows_of(suffix.without_repeats(df, least))), key=str)


def hashed(spark, rows):
    """Rows with the hash that orders rows of one id."""
    df = spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("xxhash64(t) h")
    return [(i, h.h, t or "") for (i, t), h in zip(rows, df.collect())]


def test_repeats_match_brute_force(spark, tiny):
    got = {r["doc_id"]: r for r in rows_of(queries.op2_suffix_dedup(spark, SF))}
    for i, n, spans, kept in brute_removed([(i, 0, t) for i, t in tiny.itertuples(index=False, name=None)], 100):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (n, n - len(kept), len(spans))
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_repeats_of_odd_rows(spark, odd, odd_rows, nothing):
    assert removed(odd, 100) == brute_removed(hashed(spark, [r[:2] for r in odd_rows]), 100)
    assert removed(nothing, 100) == []


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_spliced_texts(spark, corpus, seed, monkeypatch):
    """Few letters, periods, overlaps and many partial copies, with pieces so short that texts are cut."""
    r = random.Random(seed)
    pool = ["".join(r.choice("ab") for _ in range(r.randrange(1, 260))) for _ in range(6)]
    texts = ["".join(r.choice([*pool, "ab" * 40, "x" * 60, chr(97 + r.randrange(26))]) for _ in range(r.randrange(9)))
             for _ in range(60)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    assert removed(corpus(rows).repartition(3), 100) == brute_removed([(i, 0, t) for i, t, *_ in rows], 100)


def test_pieces_cover_every_window_once():
    raw = bytes(random.Random(3).randrange(256) for _ in range(3 * suffix.PIECE + 77))
    windows = []
    for _, n, part, at, first in suffix._pieces(0, raw, 100):
        assert raw[at:at + len(part)] == part and n == len(raw)
        windows += [(at + first, min(at + first + suffix.PIECE, at + len(part) - 99))]
    assert windows[0][0] == 0 and windows[-1][1] == len(raw) - 99
    assert all(a[1] == b[0] for a, b in zip(windows, windows[1:]))


def test_interval_tree():
    assert set(suffix.intervals([0, 120, 150, 110, 20, 130], 100)) == {(150, 1, 2), (120, 0, 2), (110, 0, 3), (130, 4, 5)}


# personal data

def plain_pii(text):
    """The contract's patterns as they are written."""
    text = text or ""
    found = {"email": [m.span() for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
                   if all(int(p) <= 255 for p in m.group().split("."))]

    def luhn(d):
        d = [int(x) for x in d][::-1]
        return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
                     if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return found


PII = ["mail a.b+c@mail.example.com or a@b..c x@y.z_q@r.s-t.uv @@ a@b", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 1.2.3",
       "4425 4142-5915 7784 and 4425414259157784 4425414259157785", "+1 (873) 555-4781 +12 +1.2.3 ++4930123456789(", "😀 +44 20 7946 0958é",
       "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "ssn 078-05-1120", "078-05-1120", None, "", "0" * 6000 + "." + "1" * 5000,
       "a" * 3000 + "@b.c" + "d@" * 50]


def test_personal_data_matches_plain_patterns(spark, corpus, tiny):
    rows = [(i, t, "en", "s") for i, t in enumerate([*PII, *tiny.text])]
    r = random.Random(5)
    rows += [(1000 + i, "".join(r.choice("12 .-+()@ab") for _ in range(200)), "en", "s") for i in range(300)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"]] for r in rows_of(pii.detect(corpus(rows)))}
    for i, t, *_ in rows:
        base = [s for s in got[i] if s[0] in pii.BASE_KINDS]
        assert base == [(k, a, b) for k, spans in plain_pii(t).items() for a, b in spans], t
    kinds = {PII[i]: [s[0] for s in got[i] if s[0] not in pii.BASE_KINDS] for i in range(len(PII))}
    assert kinds[PII[5]] == ["iban"] and kinds[PII[6]] == ["ssn"] and kinds[PII[7]] == []


def test_personal_data_query_and_redaction(spark, corpus, tiny, nothing):
    got = {r["doc_id"]: r for r in rows_of(queries.op4_pii(spark, SF))}
    assert len(got) == len(tiny)
    for i, t in tiny.itertuples(index=False, name=None):
        spans = [f"{k}:{a}:{b}" for k, own in plain_pii(t).items() for a, b in own]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[i]["n_email"] == sum(s.startswith("email") for s in spans)
    docs = corpus([(1, "to a@b.cd, card 4425414259157784!", "en", "s"), (2, None, None, None), (3, "clean", "en", "s")])
    texts = {r["doc_id"]: r["text"] for r in rows_of(pii.redact(docs))}
    assert texts == {1: "to [EMAIL], card [CARD]!", 2: None, 3: "clean"}
    assert pii.redact(docs).columns == docs.columns
    assert rows_of(pii.detect(nothing)) == [] and rows_of(pii.redact(nothing)) == []


# tokens

def test_tokens_match_the_library(spark, odd, odd_rows, nothing, monkeypatch):
    import tiktoken

    ranks, pattern = queries.vocabulary()
    encoder = bpe._encoder(bpe._read(ranks), pattern)
    assert isinstance(encoder, tiktoken.Encoding)
    tokens = bpe.decode(bpe.encode(odd, ranks, pattern), ranks, pattern)
    key = lambda x: str(x)
    assert sorted(((r["doc_id"], list(r["token_ids"]), bytes(r["decoded"])) for r in rows_of(tokens)), key=key) == sorted(
        ((i, encoder.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in odd_rows), key=key)
    assert rows_of(bpe.decode(bpe.encode(nothing, ranks, pattern), ranks, pattern)) == []


def test_long_texts_are_cut_where_no_piece_reaches_across():
    ranks, pattern = queries.vocabulary()
    encoder = bpe._encoder(bpe._read(ranks), pattern)
    r = random.Random(9)
    for _ in range(300):
        text = "".join(r.choice(["word", "'s", "'ll", " ", "  ", "\n", "\t ", "12", "!?", "é", "\x1c", " ", "　"])
                       for _ in range(60))
        chunks = bpe.safe_chunks(text, 5)
        assert "".join(chunks) == text
        assert [t for c in chunks for t in encoder.encode_ordinary(c)] == encoder.encode_ordinary(text)


# fingerprints

def test_fingerprints_against_edits(spark, odd, odd_rows, nothing, monkeypatch):
    got = rows_of(imatch.against_edits(odd.repartition(4)))
    order = sorted(((i if i is not None else -2 ** 63, t) for i, t, *_ in odd_rows),
                   key=lambda x: (-x[0], x[1] is not None, x[1] or ""))
    want = []
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -2 ** 63, r["n_chars"], r["edited_sha256"])
                  for r in got) == sorted(want)
    prints = {}
    for r in rows_of(imatch.fingerprints(odd)):
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[103] == prints[104] and len(prints[103]) == 1 and prints[103] <= prints[None]
    assert prints[100] == prints[101] == prints[102]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert rows_of(imatch.against_edits(nothing)) == []


def test_edits_are_nearer_than_the_next_document(spark, tiny):
    got = rows_of(queries.op7_imatch(spark, SF))
    assert len(got) == len(tiny) and len({r["fingerprint"] for r in got}) <= tiny.text.nunique()
    nearer = sum(r["near_edited"] > r["near_next"] for r in got) / len(got)
    assert nearer > 0.85


def test_lexicon_is_the_band_of_all_documents(spark, tiny):
    docs = spark.createDataFrame(tiny)
    count = Counter(t for text in tiny.text for t in imatch.terms(text))
    got = {r["term"]: r["df"] for r in rows_of(imatch.lexicon(docs, rarest=50, commonest=5))}
    assert got == {t: n for t, n in count.items() if max(2, len(tiny) / 50) <= n <= len(tiny) / 5}
    assert imatch.likeness(imatch.NONE * 2, imatch.NONE * 2) == 1.0


def test_imatch_fingerprints_and_likeness_by_brute_force(spark, tiny):
    """Every column of the query from the definition: band by counts, subsets by hash, hashes of sorted terms."""
    import xxhash

    strip = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„…–—¿¡"
    docs = sorted(((i, t or "") for i, t in tiny.itertuples(index=False, name=None)), reverse=True)
    bags = {t: {w.strip(strip) for w in t.lower().split()} - {""} for _, t in docs}
    df = Counter(w for _, t in docs for w in bags[t])
    band = {w for w, c in df.items() if max(2, len(docs) / 2000) <= c <= max(2, len(docs) / 10)}

    def plain(text):
        own = {w.strip(strip) for w in text.lower().split()} - {""}
        kept = own & band if len(own & band) >= 4 else own
        out, k = [], 0
        for power, count in ((0, 1), (2, 2), (4, 6), (6, 16), (8, 24), (10, 16)):
            for _ in range(count):
                k += 1
                part = sorted(w for w in kept if xxhash.xxh64_intdigest(w, k) < 1 << 64 - power)
                out.append((xxhash.xxh32_intdigest(" ".join(part)) or 1) if part else 0)
        return out

    def near(a, b):
        used = [x == y for x, y in zip(a, b) if x or y]
        return sum(used) / len(used) if used else 1.0

    want, prints = {}, {i: plain(t) for i, t in docs}
    for (i, text), (j, following) in zip(docs, [*docs[1:], docs[0]]):
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        new = plain(changed)
        want[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), "".join(f"{h:08x}" for h in prints[i]),
                   "".join(f"{h:08x}" for h in new), near(prints[i], new), near(prints[i], prints[j]))
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"],
                         r["near_next"]) for r in rows_of(queries.op7_imatch(spark, SF))}
    assert got == want
