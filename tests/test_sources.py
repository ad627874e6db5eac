"""Slices that change at once, feedback in batches, a database, files written and read back, labels that are kept, documents to journeys."""

import csv
import glob
import json
import os
import random
import sqlite3

import pandas as pd
import pytest
import yaml
from pyspark.sql import functions as F

from factloom.operators import declared, graph, match
from factloom.sources import database, readers, sinks, versions


def app_tables(spark, app, mark, broken=False):
    rows = lambda n: spark.createDataFrame([(app, f"{mark}{k}") for k in range(n)], "app_id string, value string")
    quads = rows(3)
    if broken:
        quads = quads.withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    return {"app_applications": rows(1), "app_tables": rows(2), "quad_archive": quads}


def seen(spark, root, table):
    return sorted((r.app_id, r.value) for r in versions.read(spark, root, table).collect())


def test_an_application_is_reloaded_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/kb"
    versions.reload_app(spark, root, "a b/c", app_tables(spark, "a b/c", "old"))
    versions.reload_app(spark, root, "other", app_tables(spark, "other", "x"))
    before = {t: seen(spark, root, t) for t in app_tables(spark, "", "")}
    with pytest.raises(Exception):
        versions.reload_app(spark, root, "a b/c", app_tables(spark, "a b/c", "new", broken=True))
    assert {t: seen(spark, root, t) for t in before} == before  # its first two tables were written already
    versions.reload_app(spark, root, "a b/c", {t: df for t, df in app_tables(spark, "a b/c", "new").items() if t != "app_tables"})
    assert seen(spark, root, "quad_archive") == [("a b/c", f"new{k}") for k in range(3)] + [("other", f"x{k}") for k in range(3)]
    assert seen(spark, root, "app_tables") == [("other", "x0"), ("other", "x1")]
    versions.vacuum(spark, root)
    assert versions.current(spark, root) == {"a b/c": 1, "other": 0} and len(glob.glob(f"{tmp_path}/kb/*/v=*")) == 2
    for bad in ({"app_tables": spark.range(1)}, {"app_applications": spark.range(1), "odd": spark.range(1)}):
        with pytest.raises(ValueError):
            versions.reload_app(spark, root, "a", bad)


def plain_commands(state, commands):
    state = {k: dict(v) for k, v in state.items()}
    for c in sorted(commands, key=lambda c: c["ord"]):
        if c["kind"] == "add":
            state.setdefault(c["id"], {"app_id": c["app_id"], "unit": c["unit"], "comment": c["comment"] or None, "status": c["status"] or "open"})
        elif c["kind"] == "mark" and c["id"] in state and c["status"] in ("open", "applied", "closed", "stale"):
            state[c["id"]]["status"] = c["status"]
        elif c["kind"] == "stale":
            for v in state.values():
                if (v["app_id"], v["unit"], v["status"]) == (c["app_id"], c["unit"], "open"):
                    v["status"] = "stale"
    return state


def test_feedback_batches_apply_once(spark, tmp_path):
    root, r, state = f"file://{tmp_path}/fb", random.Random(3), {}
    put = versions.feedback_batch(spark, root)
    names = [c.split()[0] for c in versions.COMMANDS.split(", ")]
    free = list(range(1000))  # records are added before they are marked, as ids come from adding
    for batch_id in range(3):
        commands, known = [], set(state)
        for n in range(40):
            kind = r.choice(("add", "add", "mark", "stale"))
            i = free.pop(0) if kind == "add" else r.choice(sorted(known) or [5000])
            commands.append(dict.fromkeys(names) | {"ord": n, "kind": kind, "id": i, "app_id": r.choice("ab"), "unit": r.choice(("u", "v")), "comment": r.choice(("", "text")), "status": r.choice(("open", "applied", "closed", "odd")) if kind == "mark" else None})
            known |= {i} if kind == "add" else set()
        df = spark.createDataFrame([tuple(c[n] for n in names) for c in commands], versions.COMMANDS)
        after = plain_commands(state, commands)
        for _ in range(2):  # the second time changes nothing
            put(df, batch_id)
            got = {x.id: {"app_id": x.app_id, "unit": x.unit, "comment": x.comment, "status": x.status} for x in versions.read(spark, root, "feedback").collect()}
            assert got == after
        moved = {(x.id, x.was, x.status) for x in versions.read(spark, root, "changed").collect()}
        assert moved == {(i, (state.get(i) or {"status": None})["status"], v["status"]) for i, v in after.items() if (state.get(i) or {"status": None})["status"] != v["status"]}
        state = after
    put(df, 0)  # an old batch
    assert versions.read(spark, root, "feedback").count() == len(state)


def test_feedback_arrives_as_a_stream(spark, tmp_path):
    names = [c.split()[0] for c in versions.COMMANDS.split(", ")]
    row = lambda **kw: tuple(kw.get(n) for n in names)
    parts = [[row(ord=1, kind="add", id=1, app_id="a", unit="u")], [row(ord=2, kind="stale", app_id="a", unit="u"), row(ord=3, kind="add", id=2, app_id="a", unit="u")]]
    schema = spark.createDataFrame(parts[0], versions.COMMANDS).schema
    for part in parts:
        spark.createDataFrame(part, versions.COMMANDS).write.mode("append").json(str(tmp_path / "in"))
        q = spark.readStream.schema(schema).json(str(tmp_path / "in")).writeStream.foreachBatch(versions.feedback_batch(spark, f"file://{tmp_path}/fb")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {x.id: x.status for x in versions.read(spark, f"file://{tmp_path}/fb", "feedback").collect()} == {1: "stale", 2: "open"}


def test_a_database_answers_filters(spark, tmp_path):
    path, r = str(tmp_path / "kb.db"), random.Random(1)
    rows = [(r.choice(("shop", "bank")), None if k % 13 == 0 else k * 3, f"t{k} '\"%", k / 2, k % 2) for k in range(200)]
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE app_tables (app_id TEXT, id INTEGER, \"the name\" TEXT, confidence REAL, resolved INTEGER)")
        con.executemany("INSERT INTO app_tables VALUES (?, ?, ?, ?, ?)", rows)
    schema = "app_id string, id long, `the name` string, confidence double, resolved int"
    for partition, n in ((None, 1), ("id", 7), ("id", 1000)):
        df = database.read_kb_table(spark, "app_tables", "shop", schema, "sqlite3", {"database": path}, partition, n)
        assert sorted((tuple(x) for x in df.collect()), key=str) == sorted((x for x in rows if x[0] == "shop"), key=str)
        more = df.filter("confidence >= 20 AND id IN (60, 90, 120, 123, 150) AND resolved = 1").select("the name")
        assert sorted(x[0] for x in more.collect()) == sorted(x[2] for x in rows if x[0] == "shop" and x[1] in (60, 90, 120, 123, 150) and x[3] >= 20 and x[4] == 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    late = df.filter(F.length("the name") > 6)._jdf.queryExecution().executedPlan().toString()
    assert late.count("Filter (") == 1 and "app_id" not in late.split("Filter (")[1].split("\n")[0]  # only what a database isn't asked
    assert database.read_kb_table(spark, "app_tables", "none", schema, "sqlite3", {"database": path}, "id", 3).count() == 0


FACTS = "app_id string, ord long, subject string, predicate string, object string, language string, file_path string, line int, extraction_method string, confidence double, resolved boolean"


def test_fact_files_are_read_back(spark, tmp_path):
    facts = [("shop", k, f"Function:f{k}", "CALLS", f"Table:\"q' {k}\n: é", "python", f"a/f{k}.py" if k % 2 else None, k if k % 3 else None, "ast", k / 8 if k % 5 else None, k % 2 == 0) for k in range(20)]
    facts += [("bank/x", 1, "s", "FEEDS", "o", None, None, None, None, None, None), ("not asked", 1, "s", "FEEDS", "o", None, None, None, None, None, None)]
    entities = spark.createDataFrame([("shop", "Function:f1", "Function", "f1", "python", "a/f1.py", 1, 9)], "app_id string, id string, type string, name string, language string, file_path string, line_start int, line_end int")
    notes = spark.createDataFrame([("shop", 1, "say so", "Function:f1", None, None, "human")], "app_id string, ord int, text string, subject string, file_path string, line int, provenance string")
    meta = spark.createDataFrame([("shop", {"journeys_computed": "true", "language": "python"}), ("bank/x", {}), ("bare", {})], "app_id string, metadata map<string,string>")
    out = str(tmp_path / "quads")
    paths = sinks.write_quads(spark.createDataFrame(facts, FACTS), meta, out, entities, notes, spark.createDataFrame([("shop", "T", "v")], "app_id string, token string, value string"))
    assert sorted(os.path.basename(p) for p in paths) == ["bank_x_quads.yaml", "bare_quads.yaml", "shop_quads.yaml"] and len(os.listdir(tmp_path)) == 1
    good, bad = readers.quarantine(readers.scan_quads(spark, out))
    assert bad.count() == 0
    got = readers.facts_of_records(good).join(good.filter("kind = 'file'").select("file", F.col("a").alias("app_id")), "file").orderBy("app_id", "at").collect()
    want = sorted((f[0], f[1], *f[2:5], True if f[10] is None else f[10], f[9], f[6], f[7]) for f in facts if f[0] != "not asked")
    assert [(r.app_id, r.subject, r.predicate, r.object, r.resolved, r.confidence, r.file_path, r.line) for r in got] == [(w[0], *w[2:]) for w in want]
    doc = yaml.safe_load(open(f"{out}/shop_quads.yaml"))
    assert list(doc) == ["metadata", "summary", "entities", "quads", "notes", "bindings"] and doc["summary"] == {"entity_count": 1, "quad_count": 20, "note_count": 1} and doc["metadata"] == {"app_id": "shop", "journeys_computed": "true", "language": "python"}
    assert doc["entities"][0]["source"] == {"file_path": "a/f1.py", "line_start": 1, "line_end": 9} and doc["quads"][3]["relationship_type"] == "CALLS" and doc["bindings"] == {"T": "v"}
    assert yaml.safe_load(open(f"{out}/bare_quads.yaml"))["quads"] == []
    broken = spark.createDataFrame(facts, FACTS).withColumn("subject", F.when(F.col("ord") == 7, F.raise_error(F.lit("x")).cast("string")).otherwise("new"))
    with pytest.raises(Exception):
        sinks.write_quads(broken, meta, out)
    assert yaml.safe_load(open(f"{out}/shop_quads.yaml")) == doc


def test_documents_are_written_by_unit(spark, tmp_path):
    paths = sinks.write_documents(spark.createDataFrame([("u 1", "# T\n\n- é\n"), ("v", "x")], "unit string, markdown string"), str(tmp_path / "md"))
    assert [os.path.basename(p) for p in paths] == ["u_1.md", "v.md"] and open(tmp_path / "md" / "u_1.md").read() == "# T\n\n- é\n"


def test_graph_files_hold_every_property(spark, tmp_path):
    facts = spark.createDataFrame([("a", 1, "Function:f", "CALLS", "Table:t", True, 0.5, ""), ("a", 2, "Function:f", "CALLS", "Table:t", False, None, "ast"), ("a", 3, "Function:f", "EXPOSES_ENDPOINT", "APIEndpoint:GET /x, \"y\"", None, None, None), ("b", 4, "Function:g", "WRITES_DATABASE", "Table:${T}", True, 1.0, "ast"), ("a", 5, "Function:f", "QUERIES_DATABASE", "Table:t", True, 1.0, " ast ")], "app_id string, ord long, subject string, predicate string, object string, resolved boolean, confidence double, extraction_method string")
    entities = spark.createDataFrame([("a", "Function:f", "Function", "src/core/f.py", "python"), ("b", "Table:${T}", "Table", "x/y/z.sql", None)], "app_id string, id string, type string, file_path string, language string")
    nodes, edges = graph.graph_tables(facts, entities)
    sinks.write_graph_csv(nodes, edges, str(tmp_path / "g"))

    def rows(kind, app):
        return [x for p in glob.glob(f"{tmp_path}/g/{kind}/app_id={app}/*.csv") for x in csv.DictReader(open(p))]

    a = {x["~id"]: x for x in rows("nodes", "a")}
    assert list(next(iter(a.values()))) == ["~id", "~label", "name:String", "display_name:String", "app_id:String", "path_prefix:String", "entity_count:String", "component_id:String", "language:String", "file_path:String", "kind:String", "resolved:String"]
    assert a["a:Function:f"]["component_id:String"] == "a:Component:core" and a["a:Function:f"]["language:String"] == "python" and a["a"]["display_name:String"] == "a"
    assert a['a:Endpoint:GET /x, "y"']["kind:String"] == "exposed" and a["a:Component:core"]["entity_count:String"] == "1" and (a["a:Table:t"]["~label"], a["a:Table:t"]["resolved:String"]) == ("Table", "True")
    b = {x["~id"]: x for x in rows("nodes", "b")}
    assert b["b:Table:${T}"]["file_path:String"] == "x/y/z.sql" and b["b:Table:${T}"]["resolved:String"] == ""  # the entity came first
    calls = [x for x in rows("edges", "a") if x["~label"] == "CALLS"]
    assert len(calls) == 1 and (calls[0]["resolved:String"], calls[0]["extraction_method:String"], calls[0]["confidence:String"]) == ("false", "ast", "")
    assert {x["~label"] for x in rows("edges", "a")} == {"CALLS", "CONTAINS", "DEFINES", "EXPOSES_ENDPOINT", "QUERIES_DATABASE"}


def test_labels_are_asked_for_once(spark, tmp_path):
    root, log = f"file://{tmp_path}/labels", str(tmp_path / "asked")

    def shout(frames):
        for pdf in frames:
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in pdf["text"])
            if (pdf["text"] == "bad").any():
                raise RuntimeError("no answer")
            yield pdf.assign(label=pdf["text"].str.upper())[["fingerprint", "label"]]

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string").coalesce(1)
    ask = lambda *t, **kw: sorted((x.label or "", x.note or "") for x in match.label_once(texts(*t), shout, root, **kw).collect())
    assert ask("a", "b", "a") == [("A", ""), ("B", "")] and ask("b") == [("B", "")]
    assert ask("b", "c") == [("B", ""), ("C", "")]
    assert sorted(open(log).read().split()) == ["a", "b", "c"]
    match.compact_labels(spark, root)
    assert ask("a", "b", "c") == [("A", ""), ("B", ""), ("C", "")] and len(open(log).read().split()) == 3
    assert ask("bad") == [("", "RuntimeError: no answer")] and ask("bad", "a") == [("", "RuntimeError: no answer"), ("A", "")]
    assert ask("a", salt="2") == [("A", "")] and open(log).read().split().count("a") == 2


def test_assistance_is_kept_and_may_fail(spark, tmp_path):
    manual, generated = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, name string"), spark.createDataFrame([(10,), (11,)], "id long")
    matches, asked = spark.createDataFrame([(3,)], "ref_id long"), []

    def ask(missing, gen):
        asked.append(1)
        return spark.createDataFrame([(1, 10, True), (2, 99, True), (3, 10, True), (2, 11, False)], "manual long, generated long, covers boolean"), spark.createDataFrame([(11,), (50,)], "id long")

    run = lambda f, **kw: [sorted(tuple(r) for r in df.collect()) for df in match.coverage_assist(manual, generated, matches, f, **kw)]
    cache = f"file://{tmp_path}/assist"
    assert run(ask, cache=cache) == run(ask, cache=cache) == [[(1,)], [(11,)], []] and len(asked) == 1
    run(ask, cache=cache, salt="2")
    assert len(asked) == 2

    def late(missing, gen):
        credits, redundant = ask(missing, gen)
        return credits.withColumn("covers", F.raise_error(F.lit("timed out")).cast("boolean")), redundant

    for broken in (late, lambda *_: 1 / 0):
        credited, redundant, notes = run(broken)
        assert credited == redundant == [] and len(notes) == 1 and notes[0][0].startswith("coverage assist failed: ")


def test_a_chain_runs_from_documents_to_journeys(spark):
    """A machine's definition and the manifest that names it: a journey with a door, without a line of code."""
    manifest = {"functions": {"load": {"handler": "jobs/load.run"}}, "stateMachines": {"nightly": {"definition": "./flows/n.asl.json"}}}
    machine = {"StartAt": "A", "States": {"A": {"Resource": "arn:aws:lambda:r:1:function:load", "Next": "B"}, "B": {"End": True}}}
    docs = declared.as_json(spark.createDataFrame([("m.yml", json.dumps(manifest)), ("flows/n.asl.json", json.dumps(machine))], "file string, text string"))
    states = declared.machine_states(docs)
    facts = declared.manifest_facts(docs).unionByName(declared.state_machine_facts(docs, states)).withColumn("ord", F.monotonically_increasing_id())
    entities = declared.wiring_entities(docs, states)
    assert {r.id for r in entities.collect()} == {"LambdaFunction:load", "StateMachine:nightly", "State:nightly::A", "State:nightly::B"}
    got = graph.journeys(facts, entities).collect()
    assert [(r.entry, r.kind, r.members, r.family) for r in got] == [("StateMachine:nightly", "journey", 4, "nightly")]
    assert [(r.id, r.type) for r in graph.journey_entities(facts, entities).collect()] == [("Journey:StateMachine:nightly", "Journey")]
    members = {(r.predicate, r.object) for r in graph.journey_facts(facts, entities).collect()}
    assert members == {("STARTS_AT", "StateMachine:nightly"), *(("HAS_MEMBER", x) for x in ("State:nightly::A", "State:nightly::B", "LambdaFunction:load", "Function:jobs.load.run"))}


def test_dead_ends_are_found_by_name_and_by_call(spark):
    facts = spark.createDataFrame([("StateMachine:a", "FEEDS", "State:x"), ("Function:f", "INVOKES_STEP_FUNCTION", "StateMachine:b"), ("State:x", "INVOKES_LAMBDA", "LambdaFunction:l"), ("State:x", "INVOKES_LAMBDA", "LambdaFunction:m"), ("LambdaFunction:m", "HANDLED_BY", "Function:g"), ("StateMachine:c", "MENTIONS", "nothing")], "subject string, predicate string, object string")
    assert {(r.node, r.kind) for r in graph.dead_ends(facts).collect()} == {("StateMachine:b", "named"), ("StateMachine:c", "named"), ("LambdaFunction:l", "target")}


def test_a_missing_artifact_is_an_error(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1)], "name string, rank int")
    assert [tuple(r) for r in readers.prefer(df, ["name"], "rank", df.select("name")).collect()] == [("a", 1)]
    with pytest.raises(FileNotFoundError):
        readers.prefer(df, ["name"], "rank", spark.createDataFrame([("b",)], "name string"))


def test_feature_files_and_tables_are_scanned(spark, tmp_path):
    (tmp_path / "f" / "deep").mkdir(parents=True)
    (tmp_path / "f" / "deep" / "x.feature").write_text("Feature: f\nScenario: s\n")
    (tmp_path / "f" / "y.txt").write_text("no")
    assert [r.text for r in readers.scan_features(spark, str(tmp_path / "f")).collect()] == ["Feature: f\nScenario: s\n"]
    pdf = pd.DataFrame({"app_id": ["a", "b"], "v": [1, 2]})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "t"))
    kb = readers.read_kb(spark, str(tmp_path / "t"), "b")
    assert [tuple(r) for r in kb.collect()] == [("b", 2)] and "PushedFilters: [IsNotNull(app_id), EqualTo(app_id,b)]" in kb._jdf.queryExecution().executedPlan().toString()


def test_files_of_many_rows_keep_every_section(spark, tmp_path):
    """The sections are dealt by application in several shuffles, which adaptive execution may cut differently."""
    n = 60_000
    facts = spark.range(n).selectExpr("concat('a', id % 7) AS app_id", "id AS ord", "concat('F:', sha2(string(id), 512)) AS subject", "'CALLS' AS predicate", "concat('F:', sha2(string(-id), 512)) AS object", "'python' AS language", "'a.py' AS file_path", "1 AS line", "'ast' AS extraction_method", "0.5D AS confidence", "true AS resolved")
    meta = facts.select("app_id").distinct().withColumn("metadata", F.create_map(F.lit("language"), F.lit("python")))
    path = f"file://{tmp_path}/quads"
    assert len(sinks.write_quads(facts, meta, path)) == 7
    got = {(r.kind, r.error): r["count"] for r in readers.scan_quads(spark, path).groupBy("kind", "error").count().collect()}
    assert got == {("file", None): 7, ("fact", None): n}


def test_names_that_would_share_a_file_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", 0, "x"), ("a_b", 0, "y"), ("c", 0, "z")], "name string, pos int, line string")
    with pytest.raises(OSError, match="a_b"):
        sinks.write_files(rows, f"file://{tmp_path}/out", ".txt")
    assert not glob.glob(f"{tmp_path}/out/*")


def test_files_nested_too_deep_are_left_out(spark, tmp_path):
    (tmp_path / "deep.yaml").write_text("a: [\n" * 3000)
    (tmp_path / "good.yaml").write_text("T: one\n")
    assert [tuple(r) for r in readers.load_bindings(spark, str(tmp_path)).collect()] == [("T", "one")]
    (tmp_path / "deep.json").write_text("[" * 200_000)
    (tmp_path / "good.json").write_text('{"unit": "u"}')
    assert [r.unit for r in readers.scan_requirements(spark, str(tmp_path)).collect()] == ["u"]


def test_fact_files_are_split_by_lines(spark, tmp_path):
    facts = spark.createDataFrame([("shop", k, f"Function:f{k}", "CALLS" if k % 7 else "", f"Table:é {k}", "python", "a.py", k, "ast", 0.5, True) for k in range(300)], FACTS)
    out = str(tmp_path / "quads")
    sinks.write_quads(facts, spark.createDataFrame([("shop", {"language": "python"})], "app_id string, metadata map<string,string>"), out)
    for name, text in {"odd [1].yaml": "quads:\n- subject: s\n  predicate: p\n  object: o\n", "twice.yml": 'metadata: {"app_id": "x"}\nquads: []\nquads:\n- {"subject": "s", "predicate": "p", "object": "o"}\n', "cut.yaml": 'metadata: {"app_id": "x"}\nquads:\n- {"subject": \n'}.items():
        (tmp_path / "quads" / name).write_text(text)
    limits = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "4096"}  # the large file is no one's to hold
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, x in limits.items():
            spark.conf.set(k, x)
        rows = [(os.path.basename(r.file), r.kind, r.at, r.a, r.c, r.error) for r in readers.scan_quads(spark, out).collect()]
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    shop = sorted((r[2], r[3], r[4], r[5]) for r in rows if r[0] == "shop_quads.yaml" and r[1] == "fact")
    assert shop == [(k, f"Function:f{k}", f"Table:é\u2028{k}", None) if k % 7 else (k, None, None, "missing predicate") for k in range(300)]
    others = {(name.replace("%20", " "), kind): error for name, kind, _, _, _, error in rows if name != "shop_quads.yaml"}
    assert others[("odd [1].yaml", "fact")] is None and others[("twice.yml", "fact")] is None and others[("cut.yaml", "file")]
