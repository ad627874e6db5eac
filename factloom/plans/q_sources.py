"""Queries over sources and sinks: what a sink wrote from the tables is read back and compared.

Files lie in the shared folder, with the other staged tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lookup as L
from ..sources import readers, sinks, versions
from ..sources.staged import shared_dir, sized
from ..streaming.ingest import ingest_stream
from .q_lookup import KB
from .registry import query


def _new(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _write_quads(facts: DataFrame, path: str, **more: DataFrame) -> None:
    meta = facts.select("app_id").distinct().withColumn("metadata", F.create_map(F.lit("language"), F.lit("python")))
    sinks.write_quads(facts, meta, path, **more)


def _records(v) -> DataFrame:
    facts = v("shop_facts")
    path = _new(facts, "fact-files")
    _write_quads(facts, path)
    return readers.scan_quads(facts.sparkSession, path).withColumn("app_id", F.regexp_extract("file", "([^/]+)_quads[.]yaml$", 1))


_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY ord) - 1 AS \"at\" FROM shop_facts)"


@query("a01_fact_files", f"WITH {_PLACED} SELECT app_id, \"at\", subject, predicate, object, resolved, confidence, file_path, line FROM placed WHERE predicate <> ''")
def a01(v):
    good = readers.quarantine(_records(v))[0]
    apps = sized(good.filter("kind = 'file'").select("file", "app_id"), "applications")
    return readers.facts_of_records(good).join(apps, "file").drop("file")


@query("a02_quarantine", f"WITH {_PLACED} SELECT app_id, 'fact' AS kind, \"at\", 'missing predicate' AS error, object FROM placed WHERE predicate = ''")
def a02(v):
    return readers.quarantine(_records(v))[1].select("app_id", "kind", "at", "error", F.get_json_object("extra", "$.object").alias("object"))


_SHOP = "'shop' || (c_custkey % 40)"


@query("a13_fact_file_sections", f"WITH p AS (SELECT app_id, 'fact' AS kind FROM shop_facts WHERE predicate <> '' UNION ALL SELECT DISTINCT app_id, 'file' FROM shop_facts UNION ALL SELECT {_SHOP}, 'entity' FROM customer UNION ALL SELECT {_SHOP}, 'note' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT app_id, 'binding' FROM (SELECT DISTINCT {_SHOP} AS app_id, c_nationkey FROM customer) y) SELECT app_id, kind, count(*) AS n FROM p WHERE app_id IN (SELECT app_id FROM shop_facts) GROUP BY ALL")
def a13(v):
    facts, c = v("shop_facts"), v("customer").withColumn("app_id", F.expr("concat('shop', c_custkey % 40)"))
    path = _new(facts, "fact-files")
    entities = c.selectExpr("app_id", "concat('Method:cust.', c_custkey) AS id", "'Method' AS type", "c_name AS name", "'python' AS language", "'a.py' AS file_path", "1 AS line_start", "2 AS line_end")
    notes = c.filter("c_acctbal < 0").selectExpr("app_id", "c_custkey AS ord", "concat('owes: ', c_acctbal) AS text", "c_name AS subject", "'a.py' AS file_path", "1 AS line", "'code' AS provenance")
    bindings = c.selectExpr("app_id", "concat('T', c_nationkey) AS token", "cast(c_nationkey AS string) AS value").distinct()
    _write_quads(facts, path, entities=entities, notes=notes, bindings=bindings)
    good = readers.quarantine(readers.scan_quads(facts.sparkSession, path))[0]
    return good.groupBy(F.regexp_extract("file", "([^/]+)_quads[.]yaml$", 1).alias("app_id"), "kind").agg(F.count("*").alias("n"))


@query("a03_requirements", "SELECT name AS unit, s_name AS title, n % 2 = 0 AS requirement_backed, CASE WHEN n % 4 <> 0 THEN 0.5::DOUBLE END AS confidence, 'rule \"' || n || '\"' AS rules, n::BIGINT AS feedback, sha256(line) AS source_hash FROM requirement_files JOIN supplier ON s_suppkey = n WHERE n % 10 NOT IN (3, 5)")
def a03(v):
    files = v("requirement_files")
    path = _new(files, "requirement-files")
    sinks.put_files(files.select("name", F.lit(0).alias("pos"), "line"), path, ".json")
    docs = readers.scan_requirements(files.sparkSession, path)
    return docs.select("unit", "title", "requirement_backed", "confidence", F.col("sections")["Business Rules"].alias("rules"), F.col("feedback_ids")[0].alias("feedback"), "source_hash")


@query("a04_requirement_docs", "SELECT 'doc' || s_suppkey || '.md' AS name, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS root, CASE WHEN s_suppkey % 3 = 0 THEN 'delivered ' ELSE 'generated ' END || s_name || chr(10) AS text FROM supplier")
def a04(v):
    s = v("supplier")
    delivered, generated = _new(s, "delivered"), _new(s, "generated")
    readme = s.groupBy().agg(F.count("*").cast("string").alias("line")).select(F.lit("ReadMe").alias("name"), F.lit(0).alias("pos"), "line")
    sinks.put_files(s.filter("s_suppkey % 3 = 0").selectExpr("concat('Doc', s_suppkey) AS name", "0 AS pos", "concat('delivered ', s_name) AS line").unionByName(readme), delivered, ".md")
    sinks.put_files(s.selectExpr("concat('doc', s_suppkey) AS name", "0 AS pos", "concat('generated ', s_name) AS line").unionByName(readme), generated, ".md")
    return readers.scan_requirement_docs(s.sparkSession, [delivered, generated]).select("name", "root", "text")


_STEPS = "SELECT replace(feature_file, '.feature', '') AS name, conv_id, pos, concat(keyword, ' ', replace(text, chr(10), ' ')) AS line FROM {scenarios}"


@query("a05_features", f"WITH s AS ({_STEPS.format(scenarios='scenarios')}) SELECT name || '.feature' AS file, count(*) AS steps, md5(string_agg(line, chr(10) ORDER BY conv_id, pos, line) || chr(10)) AS digest FROM s GROUP BY name")
def a05(v):
    scenarios = v("scenarios")
    path = _new(scenarios, "feature-files")
    rows = scenarios.sparkSession.sql(_STEPS, scenarios=scenarios).select("name", F.struct("conv_id", "pos", "line").alias("pos"), "line")
    sinks.write_files(rows, path, ".feature")
    lines = F.regexp_count("text", F.lit("\n")).cast("long").alias("steps")
    return readers.scan_features(scenarios.sparkSession, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), lines, F.md5("text").alias("digest"))


@query("a06_parquet_prefix", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def a06(v):
    o = v("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = _new(o, "prefix")
    o.filter("o_orderstatus = 'F'").write.parquet(f"{path}/a")
    o.filter("o_orderstatus <> 'F'").write.parquet(f"{path}/b/c")
    return readers.read_parquet_prefix(o.sparkSession, path)


@query("a07_bindings", "SELECT 's' || s_suppkey AS token, CASE WHEN s_suppkey % 2 = 0 THEN 'site ' ELSE 'base ' END || s_name AS value FROM supplier UNION ALL SELECT 'last', max(s_suppkey)::VARCHAR FROM supplier")
def a07(v):
    s = v("supplier")
    path = _new(s, "binding-files")
    lines = lambda name, line, rows=s: rows.select(F.lit(name).alias("name"), F.col("s_suppkey").cast("long").alias("pos"), F.expr(line).alias("line"))
    last = s.groupBy().agg(F.max("s_suppkey").alias("s_suppkey"))
    parts = [lines("1-base", "concat('s', s_suppkey, ': base ', s_name)"), lines("2-site", "concat('s', s_suppkey, ': site ', s_name)", s.filter("s_suppkey % 2 = 0"))]
    parts += [lines("3-list", "concat('- s', s_suppkey)"), lines("4-broken", "concat('s', s_suppkey, ': [')"), lines("5-number", "concat('last: ', s_suppkey)", last)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sinks.write_files(rows, path, ".yaml")
    return readers.load_bindings(s.sparkSession, path)


@query("a08_fact_table", f"WITH {KB} SELECT * FROM kb WHERE app_id = 'core'")
def a08(v):
    kb = L.kb_names(v("facts"))
    path = _new(kb, "kb-names")
    kb.write.partitionBy("app_id").parquet(path)
    return readers.read_kb(kb.sparkSession, path, "core")


@query("a09_reload", "SELECT 'quad_archive' AS table_name, app_id, ord FROM facts UNION ALL SELECT 'app_notes', app_id, ord FROM facts WHERE app_id = 'events' AND NOT resolved UNION ALL SELECT DISTINCT 'app_applications', app_id, CASE app_id WHEN 'core' THEN 2::BIGINT ELSE 0::BIGINT END FROM facts")
def a09(v):
    facts = v("facts").select("app_id", "ord", "resolved")
    spark, root = facts.sparkSession, _new(facts, "kb")
    own = lambda n: facts.select("app_id").distinct().withColumn("ord", F.lit(n).cast("long"))
    rows, notes = facts.select("app_id", "ord"), facts.filter("NOT resolved").select("app_id", "ord")
    for app in ("core", "events"):
        versions.reload_app(spark, root, app, {"app_applications": own(0), "quad_archive": rows.filter("app_id = 'events' OR ord % 2 = 0"), "app_notes": notes})
    versions.reload_app(spark, root, "core", {"app_applications": own(2), "quad_archive": rows})  # whole, and without notes
    tables = [versions.read(spark, root, t, "app_id string, ord long").withColumn("table_name", F.lit(t)) for t in ("quad_archive", "app_notes", "app_applications")]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


_CSV_NODES = "SELECT 'node' AS kind, 'c' || c_custkey AS id, 'Customer' AS label, '\"' || c_name || '\", ' || c_mktsegment AS name, '' AS src, '' AS dst, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment ELSE '' END AS segment, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::VARCHAR ELSE '' END AS nation, 'app' || (c_nationkey % 5) AS app_id FROM customer"
_CSV_EDGES = "SELECT 'edge', 'e' || o_orderkey, 'PLACED', '', 'c' || o_custkey, 'o' || o_orderkey, '', '', 'app' || (o_custkey % 5) FROM orders"


@query("a12_graph_files", f"{_CSV_NODES} UNION ALL {_CSV_EDGES}")
def a12(v):
    said = F.map_filter(F.create_map(F.lit("segment"), F.expr("CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END"), F.lit("nation"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN string(c_nationkey) END")), lambda _, x: x.isNotNull())
    nodes = v("customer").select(F.expr("concat('c', c_custkey)").alias("id"), F.lit("Customer").alias("label"), F.expr("concat('\"', c_name, '\", ', c_mktsegment)").alias("name"), said.alias("properties"), F.lit(0).alias("rank"), F.expr("concat('app', c_nationkey % 5)").alias("app_id"))
    edges = v("orders").selectExpr("concat('e', o_orderkey) AS id", "concat('c', o_custkey) AS src", "concat('o', o_orderkey) AS dst", "'PLACED' AS label", "cast(map() AS map<string, string>) AS properties", "concat('app', o_custkey % 5) AS app_id")
    path = _new(nodes, "graph")
    sinks.write_graph_csv(nodes, edges, path)
    read = lambda name: nodes.sparkSession.read.options(header=True, escape='"').csv(f"{path}/{name}")
    pick = lambda df, **c: df.select(*[F.coalesce(F.col(f"`{x}`"), F.lit("")).alias(k) if x else F.lit("").alias(k) for k, x in c.items()])
    n = pick(read("nodes").withColumn("kind", F.lit("node")), kind="kind", id="~id", label="~label", name="name:String", src="", dst="", segment="segment:String", nation="nation:String", app_id="app_id")
    return n.unionByName(pick(read("edges").withColumn("kind", F.lit("edge")), kind="kind", id="~id", label="~label", name="", src="~from", dst="~to", segment="", nation="", app_id="app_id"))


@query("a15_report", "SELECT o_custkey AS customer, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
def a15(v):
    report = v("orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    path = _new(report, "report")
    sinks.write_report(report, path)
    return report.sparkSession.read.schema(report.schema).json(path)


@query("k03_onboarding", "SELECT app_id, subject, predicate, object, resolved, confidence, file_path, line FROM shop_facts WHERE predicate <> '' AND (shop < 20 OR ord % 2 = 0)")
def k03(v):
    facts = v("shop_facts")
    spark, root = facts.sparkSession, _new(facts, "onboarding")
    run = lambda: ingest_stream(spark, f"{root}/files/*", f"{root}/kb", f"{root}/checkpoint").awaitTermination()
    _write_quads(facts.filter("ord % 2 = 0"), f"{root}/files/first")
    run()
    _write_quads(facts.filter("shop < 20"), f"{root}/files/second")  # these applications again, whole
    run()
    return spark.read.parquet(f"{root}/kb/facts").drop("file", "at")
