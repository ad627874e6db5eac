"""Small cases: matching against a plain loop, sources, sinks, streams, walks with cycles."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import declared, enrich, graph, lookup, match, quality, resolve, text
from factloom.plans import q_enrich, q_lookup, views
from factloom.sources import readers, sinks
from factloom.streaming.ingest import ingest_stream
from factloom.streaming.spans import assemble_spans

PROFILE = "side string, app_id string, id long, name string, feature_file string, stage string, intent string, actions array<string>, outcomes array<string>"


def plain_score(a, b):
    near = {("transform", "extract"), ("validate", "load"), ("load", "validate")}
    jac = lambda x, y: 1.0 if not x and not y else len(set(x) & set(y)) / len(set(x) | set(y))
    if a[6] != b[6] and "neutral" not in (a[6], b[6]):
        return 0.0
    st = 1.0 if a[5] == b[5] else 0.7 if a[5] == "general" or (a[5], b[5]) in near else 0.0
    s = 0.30 * st + 0.45 * jac(a[7], b[7]) + 0.25 * jac(a[8], b[8])
    return min(1.0, s + 0.05) if a[6] == b[6] != "neutral" else s


def test_greedy_match_equals_a_plain_loop(spark):
    random.seed(1)
    some = lambda words: sorted(random.sample(words, random.randint(0, 2)))
    rows = [(random.choice(["ref", "cand"]), f"s{k % 3}", k, f"n{k}", "f", random.choice(["general", "transform", "extract", "load"]), random.choice(["positive", "negative", "neutral"]), some(["a", "b", "c"]), some(["x", "y"])) for k in range(150)]
    df = spark.createDataFrame(rows, PROFILE)
    got = {(r.ref_id, r.cand_id) for r in match.greedy_match(df.filter("side = 'ref'"), df.filter("side = 'cand'")).collect()}
    want = set()
    for app in ("s0", "s1", "s2"):
        ref, cand = ([r for r in rows if r[0] == s and r[1] == app] for s in ("ref", "cand"))
        pairs = sorted(((-plain_score(a, b), a[2], b[2]) for a in ref for b in cand if plain_score(a, b) >= 0.45))
        used = set()
        for _, i, j in pairs:
            if ("r", i) not in used and ("c", j) not in used:
                used |= {("r", i), ("c", j)}
                want.add((i, j))
    assert got == want
    with pytest.raises(ValueError):
        match.greedy_match(df, df, threshold=0)


def test_walk_stops_in_a_cycle_and_at_the_limit(spark):
    facts = spark.createDataFrame([("a", "CALLS", "b"), ("b", "CALLS", "a"), ("a", "READS", "t")], "subject string, predicate string, object string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert [tuple(r) for r in graph.walk(facts, seeds, hops=5).collect()] == [("a", "CALLS", "b", 1), ("a", "READS", "t", 1), ("b", "CALLS", "a", 2)]
    assert graph.walk(facts, seeds, hops=5, limit=1).count() == 1
    assert graph.walk(facts, seeds, ("NONE",)).count() == 0


def test_bfs_survives_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r.node, r.hop) for r in graph.bfs(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}


def test_no_journeys_while_names_are_pending(spark):
    sf = "/root/testdata/sf0.001"
    assert graph.journeys(views.view(spark, sf, "facts"), views.view(spark, sf, "entities"), pending=True).count() == 0


def test_substitution_keeps_unknown_and_empty_tokens(spark):
    df = spark.createDataFrame([(1, "s3://${A}/${B}/${}$x"), (2, "plain"), (3, "${A}${A}")], "ord long, object string")
    b = spark.createDataFrame([("A", "late", 2), ("A", "early", 1)], "token string, value string, layer int")
    got = {r.ord: (r.text, r.fully_resolved) for r in resolve.substitute(df, "object", b).collect()}
    assert got == {1: ("s3://early/${B}/${}$x", False), 2: ("plain", True), 3: ("earlyearly", True)}


def test_scan_keeps_bad_files_and_records_apart(spark, tmp_path):
    (tmp_path / "a_quads.yaml").write_text("metadata: {app_id: shop}\nentities: [{id: 'Function:f', type: Function}, {name: x}]\nquads: [{subject: s, predicate: CALLS, object: o, context: {confidence: 0.5, resolved: false}}, {subject: s}]\nnotes: [{text: ' '}, {text: hi}]\nbindings: {T: v}\n")
    (tmp_path / "b.yml").write_text("{broken")
    good, bad = readers.quarantine(readers.scan_quads(spark, str(tmp_path)))
    assert sorted((r.kind, r.at) for r in bad.collect()) == [("entity", 1), ("fact", 1), ("file", 0)]
    f = readers.facts_of_records(good).collect()
    assert [(r.subject, r.object, r.confidence, r.resolved) for r in f] == [("s", "o", 0.5, False)]
    report = {r.file.rsplit("/", 1)[1]: r.status for r in readers.ingest_report(good.unionByName(bad)).collect()}
    assert report == {"a_quads.yaml": "succeeded", "b.yml": "failed"}
    assert good.filter("kind = 'note'").count() == 1


def test_streamed_onboarding_replaces_one_slice(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    fact = "quads: [{{subject: {0}, predicate: CALLS, object: o}}]\nmetadata: {{app_id: {1}}}\n"
    (source / "one.yaml").write_text(fact.format("old", "a"))
    (source / "two.yaml").write_text(fact.format("keep", "b"))
    run = lambda: ingest_stream(spark, str(source), str(target), str(tmp_path / "cp")).awaitTermination()
    run()
    (source / "three.yaml").write_text(fact.format("new", "a"))
    run()
    got = {(r.app_id, r.subject) for r in spark.read.parquet(f"{target}/facts").collect()}
    assert got == {("a", "new"), ("b", "keep")}


def test_spans_in_a_stream(spark, tmp_path):
    rows = [("1", "start", "2024-01-01 00:00:00", "x"), ("1", "error", "2024-01-01 00:00:02", "x"), ("2", "start", "2024-01-01 00:00:01", "y")]
    batch = spark.createDataFrame(rows, "span_id string, kind string, ts string, name string").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.span_id, r.status, r.duration_ms) for r in assemble_spans(batch).collect()] == [("1", "fail", 2000)]
    batch.write.parquet(str(tmp_path / "ev"))
    q = assemble_spans(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("spans").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.span_id, r.status) for r in spark.table("spans").collect()] == [("1", "fail")]


def test_requirements_documents_bindings_and_parquet(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (a / "Doc.json").write_text(json.dumps({"unit": "u", "confidence": None, "sections": {"x": "y"}}))
    (a / "bad.json").write_text("{")
    (b / "doc.json").write_text(json.dumps({"unit": "other"}))
    (b / "README.md").write_text("no")
    got = readers.scan_requirements(spark, str(a)).collect()
    assert [(r.unit, r.confidence, r.sections) for r in got] == [("u", None, {"x": "y"})]
    assert sorted((r.name, r.root) for r in readers.scan_requirement_docs(spark, [str(a), str(b)]).collect()) == [("bad.json", 0), ("doc.json", 0)]
    (b / "1.yaml").write_text("T: one\nL: [1]\n")
    (b / "2.yaml").write_text("T: two\n")
    assert [tuple(r) for r in readers.load_bindings(spark, str(b)).collect()] == [("T", "two")]
    spark.range(3).write.parquet(str(tmp_path / "p" / "x.parquet"))
    assert readers.read_parquet_prefix(spark, str(tmp_path / "p")).count() == 3
    with pytest.raises(Exception):
        readers.read_parquet_prefix(spark, str(a)).count()


def test_sinks_round_trip(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    nodes, edges = graph.graph_tables(views.view(spark, sf, "facts").limit(50), views.view(spark, sf, "entities").limit(50))
    sinks.write_graph_csv(nodes, edges, str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g" / "edges"), header=True).count() == edges.count()
    sinks.write_report(nodes.groupBy("label").count(), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() > 0


def test_search_takes_a_bad_pattern_literally(spark):
    src = spark.createDataFrame([("f", 0, "a(b"), ("f", 1, "ab")], "file string, pos int, line string")
    assert [r.pos for r in text.search_source(src, "(").collect()] == [0]


def test_scenarios_hold_whole_turns(spark):
    sf = "/root/testdata/sf0.001"
    got = views.view(spark, sf, "scenarios").selectExpr("conv_id", "pos AS turn", "text AS whole").join(spark.read.parquet(f"{sf}/conversations.parquet"), ["conv_id", "turn"])
    assert got.filter("length(text) > 60").count() > 0 and got.filter("NOT endswith(whole, text)").count() == 0


def test_names_that_contain_a_pattern_are_all_found(spark):
    random.seed(6)
    word = lambda n: "".join(random.choice("abAé._%") for _ in range(n))
    kb = [(random.choice("xy"), "t", k, word(random.randint(0, 9)), None, None) for k in range(150)]
    asked = [(random.choice("xy"), q) for q in ["", "%", "_", "%%_", "a", "AB", "a_b", "zzz", *(word(random.randint(1, 5)) for _ in range(60))]]
    got = {(r.app_id, r.q, r.name) for r in lookup.resolve_names(spark.createDataFrame(asked * 2, "app_id string, q string"), spark.createDataFrame(kb, "app_id string, table_name string, ord long, name string, resolved boolean, confidence double"), limit=10**6).filter("how = 'contains'").collect()}
    holds = lambda name, q: re.fullmatch(".*" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q.lower()) + ".*", name.lower(), re.S)
    names = {(r[0], r[3]) for r in kb}
    assert got == {(a, q, name) for a, q in asked if (a, q) not in names for b, name in names if a == b and holds(name, q)}


def test_claims_and_queries_reach_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    v = lambda n: views.view(spark, sf, n)
    claims = q_enrich._claims(v)
    assert claims.select("file").distinct().count() == v("documents").select("doc_id").distinct().count()
    assert claims.agg(F.max("line")).first()[0] >= 20
    assert q_lookup._queries(v).filter("q LIKE 'none.%'").count() == v("part").filter("p_partkey % 4 = 2").count()


def test_repo_map_keeps_every_unit_of_a_module(spark):
    rows = [(f, "Function", f"u{k}") for f, n in (("b.py", 50), ("a.py", 30), ("c.py", 1)) for k in range(n)]
    e = spark.createDataFrame(rows, "file_path string, type string, name string")
    assert sorted(tuple(r) for r in quality.repo_map(e).collect()) == sorted(rows)
    assert sorted(tuple(r) for r in quality.repo_map(e, 2).collect()) == sorted(r for r in rows if r[0] != "c.py")


def test_greedy_match_passes_each_id_once():
    import pandas as pd

    n = 100_000  # all of one class on each side: every reference id used to scan all candidate ids
    members = pd.DataFrame({"side": [0] * n + [1] * n, "cls": 1, "id": [*range(n), *range(n)]})
    got = match._greedy(pd.DataFrame({"app_id": ["a"], "cls": [1], "cls2": [1], "score": [0.9]}), members)
    assert len(got) == n and (got["ref_id"] == got["cand_id"]).all()


def test_walks_longer_than_eight_hops_and_their_chain(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(21)], "src string, dst string")
    walks = graph.bfs(edges, spark.createDataFrame([("n0",)], "node string"))
    assert sorted((r.hop, r.node) for r in walks.collect()) == [(k, f"n{k}") for k in range(1, 22)]
    assert sorted((r.step, r.node) for r in graph.longest_chain(walks).collect()) == [(k, f"n{k}") for k in range(22)]
    assert graph.longest_chain(walks.filter("false")).count() == 0
    assert graph.bfs(edges, spark.createDataFrame([("x",)], "node string")).count() == 0


def test_nearest_vectors_in_blocks_equal_a_full_sort(spark):
    r = random.Random(4)
    rows = [(k, [r.uniform(-1, 1) for _ in range(8)]) for k in range(90)] + [(90, [0.0] * 8), (91, None), (92, [1.0] * 8), (93, [1.0] * 8), ((1 << 60) + 1, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(x.query_id, x.rank): x.vec_id for x in match.cosine_topk(df, df.filter("vec_id % 10 = 2 OR vec_id = 90"), 4, block=3).collect()}

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) + 0.0 if n else 0.0

    for q, e in rows:
        if e is not None and (q % 10 == 2 or q == 90):
            best = sorted((-cosine(e, v), i) for i, v in rows if v is not None and i != q)[:4]
            assert [got[q, k + 1] for k in range(4)] == [i for _, i in best]


def test_units_near_names_equal_a_plain_search(spark):
    units = ["ab", "Xy.Z", "long name", "q", ""]
    names = [("dir/AB.feature", "has xy.z"), ("none", "a LONG NAME here"), ("qq", "n"), (None, "ab"), ("x", None)]
    got = sorted(((r.unit, r.name) for r in match.near_unit(spark.createDataFrame([(u,) for u in units], "unit string"), spark.createDataFrame(names, "feature_file string, name string")).collect()), key=str)
    assert got == sorted(((u, n) for u in units for f, n in names if u.lower() in (f or "\0").lower() or u.lower() in (n or "\0").lower()), key=str)


def test_spans_end_with_the_first_event_behind_them(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [(1, 7, "signup", at(1)), (2, 7, "purchase", at(1)), (3, 7, "error", at(3)), (4, 7, "purchase", at(3)), (5, 7, "signup", at(5)), (6, 8, "signup", at(2)), (9, 8, "purchase", at(4))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    from factloom.streaming.spans import close_spans

    got = {r.span_id: (r.end_id, r.duration_ms, r.status, r.parent_id) for r in close_spans(events).collect()}
    assert got == {1: (2, 0, "ok", None), 5: (None, None, "unclosed", None), 6: (9, 2000, "ok", None)}


def test_documents_that_declare_nothing_give_nothing(spark):
    from factloom.operators import declared

    files = spark.createDataFrame([("a", "{broken"), ("b", None), ("c", "just text"), ("d", "functions: {f: {events: [{s3: x}]}}"), ("e", "actions: [{name: no action}, text]"), ("f", "{StartAt: A}")], "file string, text string")
    docs = declared.as_json(files)
    assert {r.file: r.json is not None for r in docs.collect()} == {"a": False, "b": False, "c": False, "d": True, "e": True, "f": True}
    assert declared.manifest_facts(docs).count() == declared.state_machine_facts(docs).count() == declared.workflow_steps(docs).count() == 0
    assert declared.fixture_paths(files).count() == declared.coverage_rows(files).count() == 0


def test_nested_states_are_followed_to_the_end(spark):
    from factloom.operators import declared

    body = {"StartAt": "M", "States": {"M": {"Type": "Map", "ItemProcessor": {"StartAt": "P", "States": {"P": {"Branches": [{"StartAt": "Q", "States": {"Q": {"Resource": "${fn}", "Next": "End"}}}]}}}}}}
    facts = declared.state_machine_facts(declared.as_json(spark.createDataFrame([("x/flow.asl.json", json.dumps(body))], "file string, text string")))
    got = {(r.subject, r.predicate, r.object, r.resolved) for r in facts.collect()}
    s = "State:flow.asl::"
    assert got == {("StateMachine:flow.asl", "FEEDS", s + "M", False), (s + "M", "FEEDS", s + "P", False), (s + "P", "FEEDS", s + "Q", False), (s + "Q", "FEEDS", s + "End", False), (s + "Q", "INVOKES_LAMBDA", "LambdaFunction:${fn}", False)}


def test_tags_belong_to_the_first_scenario_after_a_heading(spark):
    file = "Feature: f\n@a @b\n@c-d\nScenario: one\n  Given x\n@late\nScenario: two\n  Then y\nBackground:\n  Given base\n@e\nsome prose\n@g\nScenario Outline:\n  * z\n Examples:\n | h | i |\n | 1 | 2 |\n\n | 3 | 4 |\n"
    scenarios, steps = text.parse_features(spark.createDataFrame([("f", file)], "file string, text string"))
    got = {r.scenario: (r.tags, r.examples, r.outline) for r in scenarios.collect()}
    assert got == {"one": (["a", "c-d"], [], False), "two": ([], [], False), "Unnamed scenario": (["g"], [["h", "i"], ["1", "2"], ["3", "4"]], True)}
    assert sorted((r.keyword, r.text, r.background) for r in steps.collect()) == [("Given", "base", True), ("Given", "x", False), ("Step", "z", False), ("Then", "y", False)]


def test_staged_tables_can_be_dropped(spark):
    from factloom.sources.staged import drop_staged, shared_dir, stage

    df = stage(spark.range(3), "small")
    assert df.count() == 3 and spark.sparkContext.applicationId in shared_dir(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    drop_staged(spark)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_a_part_of_the_staged_tables_can_be_dropped(spark):
    from factloom.sources.staged import drop_folder, own_folder, stage

    with own_folder(spark) as folder:
        inner = stage(spark.range(3), "inner")
    outer = stage(inner, "outer")
    drop_folder(spark, folder)
    assert outer.count() == 3 and all(folder not in f for f in outer.inputFiles())
    with pytest.raises(Exception):
        spark.read.parquet(folder + "/*").count()


def test_hot_keys_are_counted_before_they_meet(spark):
    """10^10 pairs of equal rows."""
    rows = spark.range(100_000)
    got = lookup.spec_inventory_join(rows.selectExpr("'a' AS app_id", "CASE WHEN id % 10 <> 0 THEN 'u' END AS unit"), rows.selectExpr("'a' AS app_id", "'u' AS symbol"))
    assert [tuple(r) for r in got.collect()] == [("a", 90_000 * 100_000)]
    config = rows.selectExpr("'k' AS key", "'c' AS file", "concat('t', id % 2) AS table", "id % 2 = 0 AS is_write")
    facts = enrich.config_sql_facts(config, rows.selectExpr("concat('f', id % 2) AS function", "'k' AS value"))
    assert sorted(tuple(r) for r in facts.collect()) == sorted((f"f{k}", *x) for k in range(2) for x in (("WRITES_DATABASE", "Table:t0"), ("QUERIES_DATABASE", "Table:t1"), ("READS_FILE", "c")))


def test_yaml_becomes_json_event_by_event(monkeypatch):
    import tracemalloc

    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for t in ("a: 1\nb: [1, 2.5, ~, yes, 2020-01-01, 'x', \"\\u00e9\"]\nc: {}\nd: []\ne:\n", "a: &x 1\nb: *x", "<<: {a: 1}\nb: 2", "a: 1\na: 2", "1: x\n~: y", "a: !!str 1", "- a", "", "a: .nan", "x: {y: {z: [[1], [{}]]}}\n---\n" [:-4]):
        doc = yaml.load(t, Loader=loader)
        assert declared._yaml_json(t) == (json.dumps(doc, default=str) if isinstance(doc, dict) else None)
    for bad in ("a: [", "a: 1\n---\nb: 2", "a: ="):
        with pytest.raises(yaml.YAMLError):
            declared._yaml_json(bad)
    large = "actions:\n" + "".join(f"- action: LOAD\n  name: s{k}\n  table: t{k % 4}\n" for k in range(20_000))
    tracemalloc.start()
    out = declared._yaml_json(large)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(json.loads(out)["actions"]) == 20_000 and peak < 8 * len(large)  # values as objects take over twenty times as much
