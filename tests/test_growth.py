"""Steps whose cost must follow the input: how they are planned, and that they give what plain loops give."""

import json
import os
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from factloom.functions import scalars as S
from factloom.operators import match, text
from factloom.plans import catalog
from factloom.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_batches_of_keys_longer_than_a_transfer_equal_a_plain_fold(spark):
    r = random.Random(3)
    rows = [(1, k, r.randrange(1, 900)) for k in range(25_000)] + [(k, p, 7000) for k in (2, 3) for p in range(3)] + [(4, 0, None), (4, 1, 5)]
    r.shuffle(rows)
    df = match.batch(spark.createDataFrame(rows, "doc_id long, pos int, size int"), 25, 12_000)
    want, last = {}, None
    for key, pos, size in sorted(rows, key=lambda x: x[:2]):
        if key != last:
            last, n, chars, number = key, 0, 0, 0
        size = float("nan") if size is None else size
        if n and (n >= 25 or chars + size > 12_000):
            n, chars, number = 0, 0, number + 1
        n, chars = n + 1, chars + size
        want[key, pos] = number
    assert {(x["doc_id"], x["pos"]): x["batch"] for x in df.collect()} == want
    assert "FlatMapGroups" not in plan(df)  # a call a key, each key as a whole


def test_a_block_of_queries_needs_little_memory():
    r = np.random.default_rng(1)
    rows = lambda n, at: pa.table({"vec_id": pa.array(np.arange(at, at + n)), "e": pa.FixedSizeListArray.from_arrays(r.normal(size=n * 8), 8).cast(pa.list_(pa.float64()))})
    queries, vectors = rows(match.QUERIES, 0), rows(4096, 10_000)
    tracemalloc.start()
    match._nearest(5)(queries, vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000  # was over 400 MB: all scores of 4,096 vectors, three times


def test_coverage_gap_reads_the_entities_once(spark):
    assert "l_orderkey" not in plan(catalog.QUERIES["d12_coverage_gap"](spark, SF))


def test_scenarios_meet_their_tags_and_tables_without_joins(spark):
    body = "Feature: f\n@a\n@b\nScenario: s\n  Given x\nExamples:\n | p | q |\n |---|---|\n | 1 | 2 |\nBackground:\n@lost\nRule\n@kept\nScenario:\n  Then y\n@none\n"
    df = text.parse_features(spark.createDataFrame([(1, body), (2, "Scenario: t"), (3, "@x\n")], "file long, text string"))[0]
    got = sorted((r["file"], r["feature"], r["scenario"], r["at"], r["outline"], list(r["tags"]), [list(x) for x in r["examples"]]) for r in df.collect())
    assert got == [(1, "f", "Unnamed scenario", 13, False, ["kept"], []), (1, "f", "s", 3, False, ["a", "b"], [["p", "q"], ["1", "2"]]), (2, None, "t", 0, False, [], [])]
    assert "Join" not in plan(df)


def test_many_small_files_take_few_tasks_and_nothing_of_the_driver(spark, tmp_path):
    n, path = 300, f"file://{tmp_path}/out"
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "u é_7.json").write_text("earlier")
    (tmp_path / "out" / ".u_é_7.json.crc").write_bytes(b"crc of an earlier file")
    (tmp_path / "out" / "u_é_7.json").write_text("earlier")
    lines = spark.range(n).selectExpr("concat('u é/', id) AS name", """explode(array(struct(2 AS pos, '"title": null}' AS line), struct(1 AS pos, null AS line), struct(0 AS pos, concat('{"unit": "', id, '",') AS line))) AS x""")
    made = sinks.put_files(lines.select("name", "x.pos", "x.line"), path, ".json")
    assert sorted(r["file"] for r in made.collect()) == sorted(f"u_é_{k}" for k in range(n))
    assert os.listdir(tmp_path) == ["out"] and len(os.listdir(tmp_path / "out")) == n + 1  # no sums, nothing left aside
    assert (tmp_path / "out" / "u_é_7.json").read_text() == '{"unit": "7",\n\n"title": null}\n'
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        docs = readers.scan_requirements(spark, path)
        assert docs.rdd.getNumPartitions() < n // 4  # was one a file
        assert sorted(r["unit"] for r in docs.collect()) == sorted(map(str, range(n)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before[1]
    assert json.loads((tmp_path / "out" / "u_é_299.json").read_text())["unit"] == "299"


def test_phrases_are_looked_for_in_a_text_that_is_normalised_once(spark):
    odd = ["", " ", " A_b--c ", "_no", "No_", "x\t\n\x0b\f\r y", "a _ - b\n", "É_\u00a0-Z", "no  retry__not continue, must", None]
    df = spark.createDataFrame([(t, "Then") for t in odd], "t string, k string")
    want = [None if t is None else re.sub("[ \t\n\x0b\f\r]+", " ", re.sub("[_-]+", " ", t.lower().strip(" "))) for t in odd]
    assert [r[0] for r in df.select(S.normalize("t")).collect()] == want
    for c, most in ((S.detect("t"), 1), (S.intent("t"), 1), (S.stage(["t"]), 1), (S.outcomes("k", "t"), 2)):
        assert df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= most  # was once a phrase
    got = df.select(S.detect("t"), S.intent("t"), S.stage(["t"]), S.outcomes("k", "t")).collect()
    assert [tuple(x) for x in got[-2:]] == [(["retry"], "negative", "general", ["expect_retry", "expect_stop", "retry"]), ([], "neutral", "general", [])]
