"""Repeated rows and ids, odd tables, long lists, appended archives and whole-table comparisons."""

import os
import random
import re
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate, exact_dedup, language, ngram_join, quality, repeats, sharding, warc

from test_operators import SF, SF10, WORDS, brute_repeats, key, none, odd, sentence, texts  # noqa: F401  odd and none are fixtures

ROWS = "doc_id long, text string, note string"


def kept(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_one_row_of_each_group_stays(spark):
    t = sentence(random.Random(1), 40)
    rows = [(5, "aaa unique", "a"), (5, t, "b"), (9, t, "c"), (6, "six", "d"), (6, "six", "e"), (7, "SEVEN", "f"), (7, "seven", "g"), (None, None, "h"), (None, "", "i"), (None, "x", "j")]
    df = spark.createDataFrame(rows, ROWS)
    got = kept(exact_dedup.drop_copies(df))
    assert [(i, (x or "").lower()) for i, x, _ in got] == [(5, "aaa unique"), (6, "six"), (7, "seven"), (9, t.lower()), (None, ""), (None, "x")]
    assert set(got) <= set(rows)
    near = t.split()
    near[3] = "other"
    rows = [(5, "aaa unique words that stand alone", "a"), (5, t, "b"), (9, " ".join(near), "c"), (6, "s i x x x", "d"), (6, "s i x x x", "e"), (6, "s i x x x", "d"), (7, t + " more", "f"), (8, "", "g"), (8, "", "h"), (None, "n u l l l", "i")]
    got = kept(ngram_join.drop_near_copies(spark.createDataFrame(rows, ROWS)))
    assert len(got) == 6 and {r[2] for r in got} >= {"a", "b", "g", "h", "i"} and sum(r[0] == 6 for r in got) == 1
    same = t.split()
    same[8] = "elsewhere"
    one = kept(ngram_join.drop_near_copies(spark.createDataFrame([(5, t, "a"), (5, " ".join(same), "b")], ROWS)))
    assert len(one) == 1  # two near texts under one id


def test_ties_hold_every_linked_pair(monkeypatch):
    """Also where lists count as long in one task or over all."""
    r = random.Random(8)
    base = [sentence(r, n) for n in (12, 60, 300, 1500)]
    docs = []
    for k in range(160):
        w = r.choice(base).split()
        for _ in range(r.randint(0, len(w) // 12)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        docs.append(" ".join(w))
    sets = {ngram_join.class_of(t): t for t in (ngram_join.shingle_hashes(d.encode()) for d in docs)}
    token, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    top = np.argsort(-n, kind="stable")[:200]
    shared = type("B", (), {"value": (token[top], n[top])})
    items = list(sets.items())
    pairs = [(a, b) for k, (a, x) in enumerate(items) for b, y in items[:k] if ngram_join.linked(len(np.intersect1d(x, y)), len(x), len(y))]
    assert pairs
    for here, every, flush in ((256, 2048, 1 << 19), (3, 2048, 400), (256, 5, 1 << 19), (2, 4, 900)):
        monkeypatch.setattr(ngram_join, "LONG_HERE", here)
        monkeypatch.setattr(ngram_join, "LONG", every)
        monkeypatch.setattr(ngram_join, "FLUSH", flush)
        monkeypatch.setattr(ngram_join.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
        rows = pa.RecordBatch.from_pydict({"cls": list(sets), "tokens": [t.tobytes() for t in sets.values()]})
        listed = pd.concat([b.to_pandas() for b in ngram_join._lists(3, shared)(iter([rows]))])
        root = {c: c for c in sets}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        for _, own in listed.groupby("bucket"):
            for a, b in ngram_join._tie_bucket(own).itertuples(index=False):
                root[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in pairs)


def test_sketches_never_part_linked_sets():
    r = np.random.default_rng(2)
    for n in (3, 40, 64, 500, 3000, 9000):
        one = r.integers(0, 1 << 63, n).astype(np.uint64)
        for share in (0.05, 0.14, 0.3):
            two = np.unique(np.concatenate((one[int(n * share) :], r.integers(0, 1 << 63, int(n * share)).astype(np.uint64))))
            sets = ngram_join.Sketches(np.array([n, len(two)]), np.concatenate((ngram_join.sketch(one), ngram_join.sketch(two))))
            may = bool(sets.may_link(np.array([0]), np.array([1]))[0])
            assert may or not ngram_join.linked(len(np.intersect1d(one, two)), n, len(two))
    far = [np.unique(r.integers(0, 1 << 63, 600).astype(np.uint64)) for _ in range(2)]
    assert not ngram_join.Sketches(np.array([len(x) for x in far]), np.concatenate([ngram_join.sketch(x) for x in far])).may_link(np.array([0]), np.array([1]))[0]


def test_near_components_of_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(odd).collect()), key=key)
    every = [(i, re.findall(r"[^\x20\x09-\x0D]+", t.lower())) for i, t in texts(odd)]
    size = lambda w: len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0
    assert got == sorted(((i, size(w), 4 if i in (4, 5, 6, 7) else i) for i, w in every), key=key)


def test_a_large_group_is_cut_into_blocks(spark):
    """A chain of near copies, whose ends are far apart, over many blocks."""
    r = random.Random(12)
    words = sentence(r, 700).split()
    rows = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(200)] + [(900 + k, sentence(r, 60)) for k in range(20)]
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert got == {i: 0 if i < 900 else i for i, _ in rows}


def test_repeats_on_a_whole_table(spark):
    df = spark.read.parquet(f"{SF10}/documents.parquet")
    got = sorted((tuple(x)[:5] for x in repeats.remove_repeats(df).collect()), key=key)
    want = brute_repeats([(i, t.encode()) for i, t in texts(df)])
    assert got == want and sum(x[2] > 0 for x in want) > 100


def test_long_texts_in_repeats(spark, odd):
    got = sorted((tuple(x)[:5] for x in repeats.remove_repeats(odd).collect()), key=key)
    assert got == brute_repeats([(i, t.encode()) for i, t in texts(odd)])


def test_language_keeps_labels_of_repeated_ids_apart(spark):
    rows = [(1, "alpha beta gamma " * 5, "aa"), (1, "omega psi chi " * 5, "bb"), (2, "alpha beta", "aa"), (3, "omega psi", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, p = language.train(docs)
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame([(1, "alpha gamma"), (2, "psi chi")], "doc_id long, text string"), langs, p).collect()}
    assert got[1].lang_pred == "aa" and got[2].lang_pred == "bb" and min(got[1].score, got[2].score) > 0.99


def planted(r, share):
    """180 documents, 120 of which hold an item with ``share`` of its words replaced, left out or moved."""
    items = [(k, sentence(r, r.randint(24, 120))) for k in range(60)]
    docs, want = [], set()
    for d in range(180):
        w = sentence(r, r.randint(100, 300)).split()
        if d < 120:
            k, text = items[d % 60]
            part = text.split()
            for at in sorted(r.sample(range(len(part)), int(len(part) * share)), reverse=True):  # each place once
                if d % 3 == 0:
                    part[at] = sentence(r, 1)
                elif d % 3 == 1:
                    del part[at]
                elif at + 1 < len(part):
                    part[at], part[at + 1] = part[at + 1], part[at]
            at = r.randint(0, len(w))
            w[at:at] = part
            want.add((d, k))
        docs.append((d, " ".join(w)))
    return docs, items, want


@pytest.mark.parametrize("share, least", [(0.14, 0.99), (0.25, 0.95), (0.35, 0.9)])
def test_paraphrases_of_any_kind_are_recalled(spark, share, least):
    docs, items, want = planted(random.Random(31), share)
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= least * len(want)


def test_common_words_alone_are_no_leak(spark):
    """Texts of the 72 words of which the items consist, in any order."""
    r = random.Random(33)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(3)) for _ in range(n))
    docs = spark.createDataFrame([(k, say(r.randint(20, 300))) for k in range(200)], "doc_id long, text string")
    assert decontaminate.find_leaks(docs, spark.createDataFrame([(k, say(r.randint(15, 60))) for k in range(40)], "item_id long, text string")).count() == 0


def test_short_and_very_long_items(spark, monkeypatch):
    """Items of fewer than five words count word for word; long ones go in pieces, a few passages a block."""
    r = random.Random(34)
    long = sentence(r, 900)
    docs = [(1, "x the quick, brown Fox y"), (2, "the brown quick fox"), (3, "quick brown"), (4, None), (5, sentence(r, 50) + " " + " ".join(long.split()[700:760])), (6, long), (7, "fox")]
    items = [(1, "The quick brown fox"), (2, "quick brown"), (3, "..."), (4, long), (5, "fox")]
    monkeypatch.setattr(decontaminate, "LONG", 200)
    monkeypatch.setattr(decontaminate, "PASSAGES", 60)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, b).collect()}
    assert got == {(1, 1), (1, 2), (1, 5), (2, 5), (3, 2), (5, 4), (6, 4), (7, 5)}
    short = spark.createDataFrame([x for x in items if x[0] != 4], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, short).collect()} == got - {(5, 4), (6, 4)}


def test_leaks_of_odd_rows(spark, odd):
    """Nulls, blanks, ties, repeated rows and a very long text meet a benchmark that holds two of them."""
    by = dict(texts(odd))
    bench = spark.createDataFrame([(1, by[4]), (2, by[4]), (3, " ".join(by[8].split()[25_000:25_080])), (4, ""), (5, None), (6, "a b c")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, bench).collect())
    assert got == sorted([(i, k) for i in (4, 5, 6, 6, 7) for k in (1, 2)] + [(8, 3)])
    left = decontaminate.drop_leaks(odd, bench)
    assert left.columns == odd.columns and sorted((r.doc_id for r in left.collect()), key=lambda i: (i is None, i)) == [1, 2, 3, 9, None]


def test_hashed_words_are_those_of_the_text():
    for text in ("", "  ", "One, two;three\tFOUR", "é" * 50 + " x", "w" * 70 + " " + "w" * 71):
        assert len(decontaminate.terms_of(decontaminate.words_of(text))) == len(decontaminate.words_of(text))
    raws = [decontaminate.plain(t) for t in ("a b c", "", "c b", " d ")]
    terms, n = decontaminate.terms_by_text(raws)
    assert n.tolist() == [3, 0, 2, 1] and terms[0] != terms[1] and terms[2] == terms[3] and terms[1] == terms[4]


def test_archives_can_be_added_to_and_replaced(spark, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/a"
    page = lambda *ids: warc.crawl_records(spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in ids], "page_id long, url string, html string"))
    read = lambda: sorted(r.record_id for r in warc.read_warc(spark, path).collect())
    page(1).write.format("warc").mode("append").save(path)
    page(2, 3).write.format("warc").mode("append").save(path)
    assert read() == ["urn:page:1", "urn:page:2", "urn:page:3"]
    (tmp_path / "a" / f"part-{'0' * 32}.warc.gz").write_bytes(b"half written")  # of a failed task
    assert len(read()) == 3
    page(4).write.format("warc").mode("overwrite").save(path)
    assert read() == ["urn:page:4"]
    page(5).write.format("warc").mode("append").save(path)
    assert read() == ["urn:page:4", "urn:page:5"]


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, none):
            out = stage(spark, table, SF)
            rows = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == odd.columns and len(rows) <= table.count()
            if table is none:
                assert not rows
    exact = dict(corpus_pipeline.STAGES)["exact dedup"](spark, odd, SF).select("doc_id").collect()
    assert sorted((r.doc_id for r in exact), key=lambda i: (i is None, i)) == [2, 3, 6, 7, 8, 9]


def test_filters_keep_columns(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 1), (3, 0), (9, 0)], "doc_id long, quality int")
    out = quality.keep_good(odd, quality.train(odd, labels))
    assert out.columns == odd.columns and out.count() <= odd.count()
    assert odd.filter(F.col("text").isNull()).count() == 2


def test_shards_prune_by_range_and_keep_repeated_rows(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{SF10}/documents.parquet")
    shards = sharding.write_shards(docs, str(tmp_path / "a"), shards=32).collect()
    back = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(back.select("doc_id").toPandas()["doc_id"]) == sorted(docs.select("doc_id").toPandas()["doc_id"])
    lang = docs.filter("lang is not null").first().lang
    holds = [s for s in shards if s.min_lang <= lang <= s.max_lang and s.min_n_chars <= 300]
    assert len(holds) <= len(shards) // 2  # the same rows dealt by id lie in every shard
    assert back.filter((F.col("lang") == lang) & (F.col("n_chars") <= 300)).select("shard").distinct().count() <= len(holds)
    rank = {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(docs, 32).collect()}
    curve = {r.doc_id: r.hilbert for r in sharding.assign_shards(docs, 32).collect()}
    order = sorted(rank, key=rank.get)
    assert all(curve[a] <= curve[b] for a, b in zip(order, order[1:]))
    wide = odd.withColumn("shard", F.lit("x")).withColumn("slot", F.lit("y"))
    sharding.write_shards(wide, str(tmp_path / "b"), shards=3)
    again = spark.read.parquet(str(tmp_path / "b"))
    assert again.count() == odd.count() and again.filter("doc_id = 6").count() == 2 and {len(x) for x in [again.columns]} == {len(odd.columns) + 2}
