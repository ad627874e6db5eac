"""Each operator against brute force, a library or held-out labels, and on odd tables."""

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import components, decontaminate, exact_dedup, language, ngram_join, piece_codec, quality, repeats, secret_scan, sharding, warc
from factloom.llm.queries import QUERIES

SF, SF10 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, a repeated row, one very long text, clashing column names."""
    r = random.Random(3)
    t = sentence(r, 120)
    rows = [(None, None, None, None, None, 1), (1, None, "en", "s", None, 2), (2, "", None, None, 0, 3), (3, "  \n ", "en", "s", 4, 4), (4, t, "en", "s", 5, 5), (5, t.upper(), "de", "s", 5, 6), (6, t, "en", "s", 5, 7), (6, t, "en", "s", 5, 7), (7, t + " tail", "en", "s", 5, 8), (8, sentence(r, 30_000), "en", "s", 9, 9), (9, "é", "fr", "s", 1, 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, x) for x in row)


def test_exact_groups(spark, odd, none):
    for keep, pick in (("max", max), ("min", min)):
        for fan, buckets in ((8, None), (2, 64)):
            got = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(odd, keep=keep, fan=fan, buckets=buckets).collect()), key=key)
            low = [(i, t.encode().lower()) for i, t in texts(odd)]
            want = []
            for i, t in low:
                ids = [j for j, u in low if u == t]
                best = pick(-(2**63) if j is None else j for j in ids)
                want.append((i, None if best == -(2**63) else best, len(ids), hashlib.sha256(t).hexdigest()))
            assert got == sorted(want, key=key)
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_copies(odd).columns == odd.columns


def test_near_components(spark, odd, none):
    r = random.Random(5)
    base = [sentence(r, 80) for _ in range(3)]
    rows = []
    for k in range(120):
        w = r.choice(base).split() if k % 3 else sentence(r, r.randint(1, 60)).split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.filter("doc_id > 3").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    for block in (1024, 8):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_components(df, block=block).collect()}
        every = {}
        for i, t in texts(df):
            w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
            every[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        comp = {i: i for i in every}
        ids = sorted(every)
        for _ in ids:
            before = dict(comp)
            for i in ids:
                for j in ids:
                    a, b = every[i], every[j]
                    if a and b and 100 * len(a & b) >= 75 * len(a | b):
                        comp[i] = comp[j] = min(comp[i], comp[j])
            if comp == before:
                break
        assert got == {i: (len(every[i]), comp[i]) for i in every}
    assert ngram_join.near_components(odd).count() == odd.count()
    assert ngram_join.near_components(none).count() == 0
    assert ngram_join.drop_near_copies(odd).columns == odd.columns


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100}


def brute_repeats(rows, n=repeats.LENGTH):
    count = {}
    for _, t in rows:
        for p in range(len(t) - n + 1):
            h = hash(t[p : p + n])
            count[h] = count.get(h, 0) + 1
    out = []
    for i, t in rows:
        spans = repeats.unite([(p, p + n) for p in range(len(t) - n + 1) if count[hash(t[p : p + n])] > 1])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + t[at:a], b
        kept += t[at:]
        out.append((i, len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def test_repeats(spark, odd, none):
    r = random.Random(4)
    base = [bytes(r.choice(b"abcdefgh ") for _ in range(r.randint(300, 1500))) for _ in range(8)]
    rows = []
    for i in range(80):
        t = b""
        for _ in range(r.randint(1, 3)):
            b = r.choice(base)
            a = r.randint(0, len(b) // 2)
            t += b[a : r.randint(a, len(b))] + bytes(r.choice(b"xyz") for _ in range(r.randint(0, 3)))
        rows.append((i, b"ab" * r.randint(100, 600) if i % 17 == 0 else t))
    df = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(5)
    for large in (repeats.LARGE, 4, 1):
        got = sorted((tuple(x)[:5] for x in repeats.remove_repeats(df, large=large).collect()), key=key)
        assert got == brute_repeats(rows)
    small = odd.filter("doc_id IS NULL OR doc_id <> 8")
    assert sorted((tuple(x)[:5] for x in repeats.remove_repeats(small).collect()), key=key) == brute_repeats([(i, t.encode()) for i, t in texts(small)])
    assert repeats.remove_repeats(none).count() == 0


def test_loser_tree_merges_with_right_prefixes():
    r = random.Random(1)
    for _ in range(100):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 7))]
        out = list(repeats.merge_runs([repeats.front_code(x) for x in runs]))
        assert [x[3] for x in out] == sorted(sum(runs, []))
        assert all(out[k][2] == repeats.common_prefix(out[k - 1][3], out[k][3]) for k in range(1, len(out)))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(s):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(s) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", s) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", s) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_secrets(spark, odd, none):
    r = random.Random(1)
    bits = ["password", "secret", "token", "api_key", "apikey", "Token", " ", ":", "=", '"', "'", "abcdef", "abc", "0123456789abcdef0123", "AKIA", "ABCDEFGH01234567", "é", "\n", "x", "-", "ghp_"]
    scan = secret_scan.Scanner(lane=16)
    for _ in range(300):
        some = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(8)]
        for t, spans in zip(some, scan.spans([t.encode() for t in some])):
            assert [x for x in secret_scan.code_points(t.encode(), spans) if x[2] < 3] == brute_secrets(t)
    names = ("assign", "access", "hex")
    for row in QUERIES["op8_secret_scan"](spark, SF10).join(spark.read.parquet(f"{SF10}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        base = [f"{names[k]}:{a}:{b}" for a, b, k in brute_secrets(row.text)]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert row.n_assign + row.n_access + row.n_hex == len(base)
    assert secret_scan.find_secrets(odd).count() == odd.count()
    assert secret_scan.find_secrets(none).count() == 0


def test_pieces_equal_the_library(spark, odd, none):
    import sentencepiece

    lib, own, r = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model()), piece_codec.Codec(), random.Random(2)
    bits = ["a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "日本", "😀", "<s>", "</s>", "<0x41>", "\x00", "ing", "tion", "1", '"', "\r", "<unk>"]
    for _ in range(1500):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, r.choice([3, 12, 150]))))
        ids, ends, names = own.encode(t.encode())
        assert ids.tolist() == lib.encode(t) and names == " ".join(map(str, lib.encode(t)))
        assert own.decode(ids.tolist()) == lib.decode(ids.tolist())
        assert (not len(ends)) == (not t) and (not t or (ends[-1] == len(t.encode()) and (np.diff(ends) >= 0).all()))
        some = [r.randrange(32000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randint(0, 8))]
        assert own.decode(some) == lib.decode(some)
    got = {(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in piece_codec.encode_digests(odd).collect()}
    want = set()
    for i, t in texts(odd):
        ids = lib.encode(t) + [lib.eos_id()]
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == want
    assert piece_codec.encode_digests(none).count() == 0
    spans = piece_codec.encode_spans(odd.filter("doc_id = 9")).first()
    assert spans.starts[0] == 0 and spans.ends[-1] == 2


def test_character_map_takes_the_longest_prefix():
    """A hand-made double array with the keys "a" -> "x" and "ab" -> "yz"."""
    units = [0] * 2048
    put = lambda offset, label, leaf=0: (offset << 10) | (leaf << 8) | label
    units[0] = put(256, 0)  # root's children at 256 ^ byte
    units[256 ^ 97] = put(512 ^ (256 ^ 97), 97, 1)
    units[512] = 0x80000000 | 0  # value of "a"
    units[512 ^ 98] = put(1024 ^ (512 ^ 98), 98, 1)
    units[1024] = 0x80000000 | 2  # value of "ab"
    raw = np.array(units, "<u4").tobytes()
    m = piece_codec.CharMap(len(raw).to_bytes(4, "little") + raw + b"x\0yz\0")
    assert m.longest(b"abc", 0) == (b"yz", 2) and m.longest(b"ac", 0) == (b"x", 1) and m.longest(b"c", 0) is None
    own = piece_codec.Codec()
    own.map = m
    norm, align = own.normalise(b"ab a")
    assert norm == "▁yz▁x" and align.tolist() == [0, 0, 0, 0, 0, 2, 2, 2, 3, 4]


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_quality_on_held_out_rows(spark, odd, none):
    out = {r.doc_id: r for r in QUERIES["op2_quality_classifier"](spark, SF10).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF10}/labels.parquet").collect()]
    test = [(i, q) for i, q in labels if held(i, 3, 1)]
    assert all(out[i].held_out == held(i, 3, 1) for i in out)
    assert sum(out[i].predicted == q for i, q in test) / len(test) > 0.95
    m = quality.train(odd, spark.createDataFrame([(4, 1), (5, 0), (4, None)], "doc_id long, quality int"))
    assert quality.score_quality(odd, m).count() == odd.count() and quality.score_quality(none, m).count() == 0
    assert {r.score for r in quality.score_quality(odd, None).collect()} == {0.5}
    assert quality.keep_good(odd, None).columns == odd.columns


def test_sum_of_squares_identity():
    m, r = quality.Machine(), np.random.default_rng(0)
    ids, x = r.choice(quality.SIZE, 9, replace=False), r.random(9).astype(np.float32)
    slow = m.w0[0] + (m.w[ids] * x).sum() + sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    assert abs(m.raw(np.array([0]), ids, x)[0][0] - slow) < 1e-5


def test_language_on_held_out_rows(spark, odd, none):
    out = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, SF10).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF10}/documents.parquet").collect() if held(r.doc_id, 4, 2) and r.lang}
    assert sum(out[i].lang_pred == lang for i, lang in truth.items()) / len(truth) > 0.95
    langs, p = language.train(odd)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd, langs, p).collect()]
    assert len(got) == odd.count() and all(pred == "und" and s == 0 for i, pred, s in got if i in (1, 2, 3))
    assert language.identify(none, langs, p).count() == 0
    assert {r.lang_pred for r in language.identify(odd, *language.train(none)).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    v = language.pieces(None)
    p = np.random.default_rng(0).random((v.size, 2)) * 1e-3
    word = language.SPACE + "thing"

    def every(at, k):
        return 1.0 if at == len(word) else sum((p[c, k] if c >= 0 else language.UNKNOWN) * every(j, k) for i, j, c in v.edges(word) if i == at)

    scorer = language.Scorer(p, v)
    for k in range(2):
        assert abs(scorer.forward(["thing"])[0, k] - np.log(every(0, k))) < 1e-9
    long = ["q" * 29, "thetion" * 4]
    assert np.allclose(scorer.forward(long), [scorer._forward_long(language.SPACE + w) for w in long])


def test_language_learns_from_words_of_any_length(spark):
    vocab = language.pieces(None)
    p = np.random.default_rng(4).dirichlet(np.ones(vocab.size)).tolist()
    for word in ("unsegmented", "thequickbrownfoxé"):
        prob, uses = language.expected_counts(word, p, vocab)
        total: dict = {}
        for k, n in uses:
            total[k] = total.get(k, 0.0) + n
        far, long = language._expected_long(word, p, vocab)
        assert far == pytest.approx(prob) and dict(long) == pytest.approx(total)
    size = {k: len(t) for t, k in vocab.ids.items() if k >= 0}
    assert sum(size[k] * n for k, n in language.expected_counts("abcdefghij" * 300, p, vocab)[1]) == pytest.approx(3000)
    r = random.Random(8)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(40, 900))) for _ in range(3))
    rows = [(k, text("aeioulmn" if k % 2 else "strkpdgy"), "xx" if k % 2 else "yy") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, fitted = language.train(docs.filter("doc_id < 20"))
    assert langs == ["xx", "yy"]
    assert {(x.doc_id, x.lang_pred) for x in language.identify(docs, langs, fitted).collect()} == {(k, lang) for k, _, lang in rows}


def test_decontamination(spark, odd, none):
    r = random.Random(9)
    items = [(k, sentence(r, r.randint(12, 80))) for k in range(30)] + [(90, "too short"), (91, None)]
    docs, want = [], set()
    for d in range(60):
        w = sentence(r, r.randint(20, 400)).split()
        if d % 3 == 0:
            k, text = items[d % 30]
            part = text.split()
            if d % 2:  # a paraphrase: some words go, the end stays
                for _ in range(len(part) // 8):
                    del part[r.randrange(len(part) // 2)]
            at = r.randint(0, len(w))
            w[at:at] = part
            want.add((d, k))
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(df, bench).collect()} == want
    assert decontaminate.drop_leaks(df, bench).count() == 40
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(odd, bench.filter("false")).count() == 0
    assert decontaminate.drop_leaks(odd, bench).columns == odd.columns


def test_decontamination_finds_parts_and_paraphrases_of_one_sentence(spark):
    r = random.Random(19)
    words = {k: sentence(r, n).split() for k, n in enumerate((59, 500, 500, 40, 20, 40))}
    dotted = lambda w: ". ".join(" ".join(w[a : a + 12]) for a in range(0, len(w), 12)) + "."
    bench = spark.createDataFrame([(k, dotted(w) if k < 3 else " ".join(w) + ".") for k, w in words.items()], "item_id long, text string")
    thin = lambda w, keep: [x for n, x in enumerate(w) if n >= len(w) - keep or n % 2]
    plants = {0: words[0][:45], 1: words[1][100:390], 2: words[2][333:365], 3: thin(words[3], 12), 4: thin(words[4], 8), 5: [x for n, x in enumerate(words[5]) if n % 2]}
    docs = []
    for k, part in plants.items():
        w = sentence(r, 300).split()
        at = r.randint(0, 300)
        docs.append((k, " ".join(w[:at] + part + w[at:])))
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(k, k) for k in range(5)}  # half of item 5 is no paraphrase
    assert decontaminate._answer("One two. - ", None) == [b"one", b"two"] and decontaminate._answer("a b c d e f. G h!", None) == [b"g", b"h"] and decontaminate._answer("a b", "c") == [b"c"]


def test_planted_passages_are_all_found(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, SF10).collect()}
    pad = lambda t: b" " + b" ".join(decontaminate.words_of(t)) + b" "
    items = [(r.item_id, pad(r.text)) for r in spark.read.parquet(f"{SF10}/benchmark.parquet").collect()]
    docs = [(r.doc_id, pad(r.text or "")) for r in spark.read.parquet(f"{SF10}/documents.parquet").collect()]
    assert got == {(d, k) for d, t in docs for k, item in items if item in t}


def test_warc_pushes_filters_down(spark, tmp_path):
    rows = [(k, f"http://h{k % 3}/{k}", "x" * 150 if k % 4 == 0 else f"<p>{k}</p>" * 20, k) for k in range(40)] + [(None, None, None, 0), (50, "u\r\nX: y", "", 1), (51, "e", "é" * 60, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.crawl_records(pages).write.format("warc").option("chunk_bytes", "500").option("file_bytes", "2000").mode("append").save(path)
    assert warc.read_warc(spark, path).count() == len(rows)
    some = warc.read_warc(spark, path, ["record_id", "record_type", "refers_to", "target_uri"]).filter("record_type = 'revisit' AND target_uri LIKE 'http://h0/%'")
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert {r.record_id for r in some.collect()} == {f"urn:page:{k}" for k in range(4, 40, 4) if k % 3 == 0}
    assert {r.refers_to for r in some.collect()} == {"urn:page:0"}
    back = {r.record_id: bytes(r.payload).decode() for r in warc.read_warc(spark, path).filter("record_type = 'response'").collect()}
    assert back["urn:page:51"] == "é" * 60 and back["urn:page:null"] == "" and back["urn:page:1"] == "<p>1</p>" * 20
    warc.crawl_records(pages.filter("false")).write.format("warc").mode("append").save(path + "0")
    assert warc.read_warc(spark, path + "0").count() == 0


def test_warc_reads_plain_and_ordinary_gzip(spark, tmp_path):
    import gzip

    row = {"record_id": "urn:page:7", "record_type": "response", "target_uri": "u", "payload": b"hello" * 3000, "payload_digest": "d"}
    raw = warc.record(row, "2024-01-01T00:00:00Z")
    (tmp_path / "a.warc").write_bytes(raw + raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(bytes(r.payload) == row["payload"] for r in got)
    assert warc.read_warc(spark, str(tmp_path)).filter("record_type = 'request'").count() == 0


def test_sharding(spark, odd, none):
    for df, law in ((spark.read.parquet(f"{SF10}/documents.parquet"), "rows"), (odd, "rows"), (spark.read.parquet(f"{SF10}/documents.parquet"), "bytes")):
        got = sharding.assign_shards(df, law=law).collect()
        assert len(got) == df.count() and all(0 <= r.shard < 40 for r in got)
        want = sorted(((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts(df)), key=key)
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == want
        by = {k: sorted(r.slot for r in got if r.shard == k) for k in range(40)}
        assert all(v == list(range(len(v))) for v in by.values())
        if law == "rows":
            assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
        else:
            sizes = [sum(r.size for r in got if r.shard == k) for k in range(40)]
            assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    assert sharding.assign_shards(none).count() == 0
    assert len(set(sharding.hilbert_index([np.repeat(np.arange(8), 8), np.tile(np.arange(8), 8)], 3).tolist())) == 64


def test_hilbert_neighbours_are_adjacent():
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij")).reshape(3, -1)
    order = np.argsort(sharding.hilbert_index(list(grid), 2))
    assert (np.abs(np.diff(grid[:, order], axis=1)).sum(axis=0) == 1).all()


def test_written_shards_prune(spark, tmp_path):
    manifest = sharding.write_shards(spark.read.parquet(f"{SF}/documents.parquet"), str(tmp_path / "s"), shards=4)
    assert manifest.agg(F.sum("rows")).first()[0] == 200 and "min_source" in manifest.columns


def test_pipeline(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    final = corpus_pipeline.run(spark, SF)
    model = quality.train(docs, quality.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    left = {r.doc_id: (r.text or "") for r in quality.keep_good(docs, model).collect()}
    last = {}
    for i in sorted(left):
        last[left[i].encode().lower()] = i
    left = {i: left[i] for i in last.values()}
    sets = {i: ngram_join.shingle_hashes(t.encode()) for i, t in left.items()}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in left:
        for j in left:
            if i < j and len(sets[i]) and ngram_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = {i: t for i, t in left.items() if find(i) == i}
    pad = lambda t: b" " + b" ".join(decontaminate.words_of(t)) + b" "
    items = [pad(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i, t in left.items() if not any(item in pad(t) for item in items)}
    assert {r.doc_id for r in final.collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and corpus_pipeline.ORACLE_SQL is None
