"""op11 to op13 and the table of spans, against brute force and the tokenizer's library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import filter_audit, interning, piece_codec, resampling, token_counts

from test_operators import SF10, key, none, odd, sentence, texts  # noqa: F401  odd and none are fixtures


def spans_of(items):
    buf = interning.padded(np.frombuffer(b"".join(items), np.uint8))
    sizes = np.array([len(x) for x in items], np.int64)
    return buf, np.cumsum(sizes) - sizes, sizes


def test_spans_hash_as_the_library():
    r = random.Random(1)
    items = [r.randbytes(n) for n in range(80)] + [b"", "é漢".encode(), b"x" * 5000]
    assert interning.hash_spans(*spans_of(items)).tolist() == [xxhash.xxh64_intdigest(x) for x in items]


@pytest.mark.parametrize("hashes", ["own", "one", "few"])
def test_interned_spans_are_equal_spans(monkeypatch, hashes):
    """Also where hashes collide, so that only the bytes tell spans apart."""
    if hashes != "own":
        real = interning.hash_spans
        monkeypatch.setattr(interning, "hash_spans", lambda *a: real(*a) & np.uint64(0 if hashes == "one" else 3))
    r = random.Random(2)
    items = [r.choice((b"a", b"ab", b"", b"abcdefgh", b"abcdefgi", b"abcdefghi", b"q" * 63 + b"a", b"q" * 63 + b"b", b"q" * 64 + b"a", b"q" * 64 + b"b", b"q" * 64)) for _ in range(400)]
    slots, claims = interning.intern(*spans_of(items))
    assert len(claims) == len(set(items)) and all(items[claims[s]] == x for s, x in zip(slots, items))
    group = np.array([r.randrange(3) for _ in items])
    slots, claims = interning.intern(*spans_of(items), group)
    assert len(claims) == len(set(zip(group.tolist(), items))) and all((group[claims[s]], items[claims[s]]) == (g, x) for s, g, x in zip(slots, group, items))
    assert [len(x) for x in interning.intern(*spans_of([]))] == [0, 0]


def test_chunks_cover_every_row():
    rows = [None, "", "abc", "é" * 9, None, "x", ""]
    for size in (1, 4, 1000):
        got = []
        for own, data, offsets in interning.chunks(pa.array(["skipped", *rows])[1:], size):
            assert own.start == len(got)
            got += [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
        assert got == [x or "" for x in rows]


# --- op11 --------------------------------------------------------------------


def brute_audit(docs, labels):
    good, toxic = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    first = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            first[t or ""].append(i)
    parts = defaultdict(list)
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(first[t]) < i}
        parts[part or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out, whole = {}, Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [x for x in rows if f in x[0] and not x[0] & before]
                whole[part, f] += len(here)
                out[part, "".join(order), k + 1] = [sum(not x[0] & {*before, f} for x in rows), len(here), sum(f in x[0] and bool(x[0] & before) for x in rows), sum(x[0] == {f} for x in rows), sum(x[1] for x in here), sum(x[2] for x in here)]
    return {(p, o, s): (*v, whole[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit(spark, odd):
    r = random.Random(4)
    base = [" ".join(r.choice(("one", "two", "Three", "four#", "FIVE", "é|", "six")) for _ in range(n)) for n in (3, 150, 230, 260)] + [sentence(r, 300), sentence(r, 300).replace("a", "A"), None, "", "Ü" * 40, "word " * 250]
    docs = [(r.choice((k, k, None)), r.choice(base), r.choice(("en", "fr", None, ""))) for k in range(200)]
    docs += [docs[7]] * 3 + [(-5, base[1], "en"), (-5, base[1], "fr"), (2**40, sentence(r, 20_000), "long")]
    labels = [(k % 90 if k % 11 else None, r.choice((0, 1, None)), r.choice((0, 1, None))) for k in range(150)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("digest", F.lit(1)).withColumn("mask", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in filter_audit.audit_filters(table, marks).collect()}
    assert got == brute_audit(docs, labels)
    rows = [(x.doc_id, x.text, x.lang) for x in odd.collect()]
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in filter_audit.audit_filters(odd, marks.filter("false")).collect()}
    assert got == brute_audit(rows, [])


def test_audit_of_nothing(none, spark):
    assert filter_audit.audit_filters(none, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).count() == 0


def test_transducer_statistics():
    r = random.Random(6)
    rows = ["".join(r.choice("aZ é漢😀#|\t\n\x0b\x0c\r\x1f\x85 ") for _ in range(r.randrange(60))) for _ in range(500)]
    for size in (30, 1 << 20):
        for own, data, offsets in interning.chunks(pa.array(rows), size):
            s = filter_audit.text_statistics(data, offsets)
            for k, t in enumerate(rows[own]):
                w = re.findall(r"[^\x20\x09-\x0D]+", t)
                assert [int(s[n][k]) for n in ("words", "distinct", "capitals", "points", "symbols")] == [len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))]


# --- op12 --------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())


def test_proven_strings_are_one_token(library):
    own = piece_codec.codec()
    proven = token_counts.whole_tokens(own)
    inner = [p for p in proven if p.startswith("▁") and p.strip("▁")]
    assert len(inner) > 10_000
    assert [library.encode(p[1:].replace("▁", " ")) for p in inner] == [[own.ids[p]] for p in inner]


def test_token_counts(spark, odd, none, library):
    r = random.Random(9)
    letters = "abcdeth éß漢😀<s></s>\n\t\r▁0.,'-\x00"
    strings = ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(300)] + ["<unk><s>", "  a", "a  ", " ", "▁", "x" * 20_000, " " * 5000, "the " * 5000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(strings)], "doc_id long, text string").unionByName(spark.read.parquet(f"{SF10}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    for table in (docs, odd):
        want = [(i, len(t.encode()), n := len(library.encode(t, num_threads=1)), n > 4096) for i, t in texts(table)]
        assert sorted((tuple(x) for x in token_counts.count_tokens(table).collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(none).count() == 0


def test_counts_without_the_shortcut_are_the_same():
    own = piece_codec.codec()
    with_it, without = token_counts.Counts(own, token_counts.whole_tokens(own)), token_counts.Counts(own, [])
    with_it.refill()
    text = sentence(random.Random(3), 500).encode()
    assert with_it.of(text) == without.of(text) and len(without) > 0


# --- op13 --------------------------------------------------------------------


def brute_resample(docs, target, percent=10, least=20, buckets=10_000, max_n=1):
    def split(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def buckets_of(t):
        w = split(t)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, max_n + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in buckets_of(x)), Counter(b for x in target for b in buckets_of(x))
    all_s, all_t = s.total(), t.total()
    rows = []
    for i, x in docs:
        own = buckets_of(x)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(split(x))])
    may = sorted((k for k in range(len(rows)) if rows[k][4] >= least), key=lambda k: (-rows[k][3], rows[k][0] is not None, rows[k][0] or 0))
    place = {k: n for n, k in enumerate(may[: percent * len(may) // 100], 1)}
    return sorted(((*x[:4], place.get(k)) for k, x in enumerate(rows)), key=key)


def test_features_of_blocks(monkeypatch):
    """Runs of words stay inside their text, however many are worked on at once."""
    r = random.Random(11)
    rows = [sentence(r, r.randrange(12)) + r.choice(("", "É")) for _ in range(40)] + ["", "", "one"]
    want = sorted((k, " ".join(w[i : i + n]).encode()) for k, t in enumerate(rows) for n in (1, 2, 3) for w in [t.lower().replace("É".lower(), "É").split()] for i in range(len(w) - n + 1))
    (_, data, offsets), *_ = interning.chunks(pa.array(rows))
    for block in (5, 1 << 20):
        monkeypatch.setattr(resampling, "BLOCK", block)
        got = [(int(t), buf[s : s + n].tobytes()) for _, buf, starts, sizes, text in resampling.features(data, offsets, 3) for s, n, t in zip(starts, sizes, text)]
        assert sorted(got) == want


@pytest.mark.parametrize("max_n, buckets", [(1, 10_000), (3, 500)])
def test_resampling(spark, odd, max_n, buckets):
    r = random.Random(10)
    odd_rows = [(x.doc_id, x.text) for x in odd.collect()]
    docs = odd_rows + [(100 + k, sentence(r, r.randint(0, 90)) + r.choice(("", " É漢 x_y", "@[`{ 7"))) for k in range(150)] + [(100, "again " * 30), (None, sentence(r, 60))]
    target = [sentence(r, 40), None, "", odd_rows[4][1]]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit("y"))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(x) for x in resampling.resample(table, goal, buckets=buckets, max_n=max_n, percent=30).collect()), key=key)
    assert got == brute_resample(docs, target, percent=30, buckets=buckets, max_n=max_n)


def test_resampling_of_empty_tables(spark, odd, none):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(none, nothing).count() == 0
    rows = [(x.doc_id, x.text) for x in odd.collect()]
    assert sorted((tuple(x) for x in resampling.resample(odd, nothing).collect()), key=key) == brute_resample(rows, [])
