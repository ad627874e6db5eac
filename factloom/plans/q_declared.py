"""Queries for facts that documents declare; the documents are rendered from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import declared as D
from ..operators import match as M
from .q_match import _sides
from .registry import query


def _doc(rows: DataFrame, key: str, order: str, text: str, before: str = "", after: str = "", between: str = ",") -> DataFrame:
    """One document a key: the texts of its rows in order."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.expr(order).alias("o"), F.expr(text).alias("t")))), lambda x: x["t"]), between)
    return rows.groupBy(F.expr(key).alias("file")).agg(F.concat(F.lit(before), body, F.lit(after)).alias("text"))


_FUNCTION = """concat('"fn', s_suppkey, '":{"handler":"pkg/mod', s_suppkey % 5, '.py.run', s_suppkey, '","events":[', CASE s_suppkey % 5 WHEN 0 THEN concat('{"s3":{"bucket":"b', s_nationkey, '"}}') WHEN 1 THEN concat('{"schedule":"rate(', s_suppkey, ')"}') WHEN 2 THEN '{"http":{"method":"post","path":"/p"}},{"odd":"x"}' WHEN 3 THEN concat('{"sqs":{"arn":"arn:aws:sqs:r:1:q', s_suppkey, '"}}') ELSE '{"sns":{}}' END, ']}')"""


@query("i12_manifest_facts", """WITH s AS (SELECT 'm' || s_nationkey AS file, 'LambdaFunction:fn' || s_suppkey AS subject, s_suppkey AS k, s_nationkey AS n FROM supplier), e AS (
 SELECT file, subject, 'HANDLED_BY' AS predicate, 'Function:pkg.mod' || (k % 5) || '.run' || k AS object, TRUE AS resolved FROM s
 UNION ALL SELECT file, subject, 'RECEIVES_EVENT', CASE k % 5 WHEN 0 THEN 'S3Bucket:b' || n WHEN 1 THEN 'Schedule:rate(' || k || ')' WHEN 2 THEN 'APIEndpoint:POST /p' WHEN 3 THEN 'Queue:q' || k ELSE 'Topic:<unknown>' END, k % 5 <> 4 FROM s
 UNION ALL SELECT file, subject, 'RECEIVES_EVENT', 'EventSource:odd', FALSE FROM s WHERE k % 5 = 2)
 SELECT *, CASE WHEN resolved THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM e""")
def i12(v):
    files = _doc(v("supplier"), "concat('m', s_nationkey)", "s_suppkey", _FUNCTION, '{"functions":{', "}}")
    return D.manifest_facts(D.as_json(files.unionByName(v("region").selectExpr("concat('r', r_regionkey) AS file", "concat('just: [text, ', r_name) AS text"))))


_STATES = """concat('S', o_orderkey, ': {', CASE WHEN o_orderstatus = 'P' THEN concat('Branches: [{StartAt: B', o_orderkey, ', States: {B', o_orderkey, ': {Resource: "arn:aws:lambda:x:y:function:fn', o_orderkey, '", Next: E}}}], ') WHEN o_orderstatus = 'F' THEN concat('Resource: "', CASE WHEN o_orderkey % 2 = 0 THEN 'plain' ELSE 'arn:aws:states:::lambda:invoke' END, '", Parameters: {FunctionName: par}, Choices: [{Next: C1}, {Next: C2}], ') ELSE '' END, CASE WHEN nxt IS NULL THEN 'Catch: [{Next: Fail}]' ELSE concat('Next: S', nxt) END, '}')"""


@query("i12_state_machines", """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS st, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), m AS (SELECT *, 'sm/c' || c || '.json' AS file, CASE WHEN c % 2 = 0 THEN 'named' || c ELSE 'c' || c END AS machine, c % 2 = 0 AS known FROM o),
 e AS (SELECT file, known, 'StateMachine:' || machine AS subject, 'FEEDS' AS predicate, 'State:' || machine || '::S' || k AS object FROM m WHERE n = 1
 UNION ALL SELECT file, known, 'State:' || machine || '::S' || k, 'FEEDS', 'State:' || machine || '::' || coalesce('S' || nxt, 'Fail') FROM m
 UNION ALL SELECT file, known, 'State:' || machine || '::S' || k, 'FEEDS', 'State:' || machine || '::' || x FROM m, (VALUES ('C1'), ('C2')) t(x) WHERE st = 'F'
 UNION ALL SELECT file, known, 'State:' || machine || '::S' || k, 'INVOKES_LAMBDA', 'LambdaFunction:' || CASE WHEN k % 2 = 0 THEN 'plain' ELSE 'par' END FROM m WHERE st = 'F'
 UNION ALL SELECT file, known, 'State:' || machine || '::S' || k, 'FEEDS', 'State:' || machine || '::B' || k FROM m WHERE st = 'P'
 UNION ALL SELECT file, known, 'State:' || machine || '::B' || k, 'FEEDS', 'State:' || machine || '::E' FROM m WHERE st = 'P'
 UNION ALL SELECT file, known, 'State:' || machine || '::B' || k, 'INVOKES_LAMBDA', 'LambdaFunction:fn' || k FROM m WHERE st = 'P')
 SELECT file, subject, predicate, object, known AS resolved, CASE WHEN known THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM e""")
def i12b(v):
    return D.state_machine_facts(_machines(v))


def _machines(v):
    from pyspark.sql import Window

    o = v("orders").withColumn("nxt", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    states = _doc(o, "o_custkey", "o_orderkey", _STATES, "", "", ", ")
    first = v("orders").groupBy(F.col("o_custkey").alias("file")).agg(F.min("o_orderkey").alias("k"))
    machines = states.join(first, "file").selectExpr("concat('sm/c', file, '.json') AS file", "concat('{StartAt: S', k, ', States: {', text, '}}') AS text")
    names = _doc(v("orders").select("o_custkey").distinct().filter("o_custkey % 2 = 0"), "concat('manifest', o_custkey % 4)", "o_custkey", "concat('named', o_custkey, ': {definition: ./sm/c', o_custkey, '.json}')", "{stateMachines: {", "}}", ", ")
    return D.as_json(machines.unionByName(names))


@query("i12_entities", """WITH m AS (SELECT o_orderkey AS k, o_orderstatus AS st, 'sm/c' || o_custkey || '.json' AS file, CASE WHEN o_custkey % 2 = 0 THEN 'named' || o_custkey ELSE 'c' || o_custkey END AS machine FROM orders),
 fn AS (SELECT 'm' || s_nationkey AS file, s_suppkey AS k, s_nationkey AS n FROM supplier)
 SELECT DISTINCT file, 'StateMachine:' || machine AS id, 'StateMachine' AS type, machine AS name FROM m UNION ALL SELECT file, 'State:' || machine || '::S' || k, 'State', machine || '::S' || k FROM m UNION ALL SELECT file, 'State:' || machine || '::B' || k, 'State', machine || '::B' || k FROM m WHERE st = 'P'
 UNION ALL SELECT file, 'LambdaFunction:fn' || k, 'LambdaFunction', 'fn' || k FROM fn
 UNION ALL SELECT DISTINCT file, x, split_part(x, ':', 1), x FROM (SELECT file, CASE k % 5 WHEN 0 THEN 'S3Bucket:b' || n WHEN 1 THEN 'Schedule:rate(' || k || ')' WHEN 2 THEN 'APIEndpoint:POST /p' WHEN 3 THEN 'Queue:q' || k ELSE 'Topic:<unknown>' END AS x FROM fn UNION ALL SELECT file, 'EventSource:odd' FROM fn WHERE k % 5 = 2) y""")
def i12c(v):
    manifests = D.as_json(_doc(v("supplier"), "concat('m', s_nationkey)", "s_suppkey", _FUNCTION, '{"functions":{', "}}"))
    return D.wiring_entities(_machines(v).unionByName(manifests))


@query("i13_entities", "SELECT DISTINCT 'w' || (user_id % 50) AS file, 'WorkflowFile:w' || (user_id % 50) AS id, 'WorkflowFile' AS type, 'w' || (user_id % 50) AS name FROM events UNION ALL SELECT 'w' || (user_id % 50), 'Step:w' || (user_id % 50) || '::s' || event_id, 'Step', 'w' || (user_id % 50) || '::s' || event_id FROM events")
def i13c(v):
    return D.workflow_entities(_workflows(v))


@query("i13_unknown_actions", "SELECT DISTINCT 'w' || (user_id % 50) AS file, 'ODD' AS action FROM events WHERE event_type = 'error'")
def i13d(v):
    return D.unknown_actions(_workflows(v))


_ACTION = """concat('- action: ', CASE event_type WHEN 'view' THEN 'EXTRACT' WHEN 'signup' THEN 'TRANSFORM' WHEN 'error' THEN 'ODD' ELSE 'LOAD' END, '\n  name: s', event_id, CASE event_type WHEN 'view' THEN concat('\n  dataframe: df', event_id % 7, '\n  dataBackbone: "x:name=t', event_id % 3, ':y"') WHEN 'signup' THEN concat('\n  srcDataframe: df', event_id % 7, '\n  trgDataframe: df', event_id % 5) WHEN 'error' THEN concat('\n  dataframe: df', event_id % 7, '\n  target: s3://bucket/', event_id) ELSE concat('\n  dataframe: df', event_id % 7, '\n  table: t', event_id % 4, '\n  sql: "select 1 from df', event_id % 6, '"') END)"""
_FLOWS = """s AS (SELECT 'w' || (user_id % 50) AS file, event_id AS pos, event_type AS t, 'Step:w' || (user_id % 50) || '::s' || event_id AS step FROM events),
 io AS (SELECT file, pos, step, 'out' AS role, 'df' || CASE WHEN t = 'view' THEN pos % 7 ELSE pos % 5 END AS df FROM s WHERE t IN ('view', 'signup') UNION ALL SELECT file, pos, step, 'in', 'df' || (pos % 7) FROM s WHERE t <> 'view' UNION ALL SELECT file, pos, step, 'in', 'df' || (pos % 6) FROM s WHERE t IN ('purchase', 'click') AND pos % 6 <> pos % 7),
 fed AS (SELECT *, last_value(CASE WHEN role = 'out' THEN step END IGNORE NULLS) OVER (PARTITION BY file, df ORDER BY pos, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS producer FROM io),
 e AS (SELECT file, 'WorkflowFile:' || file AS subject, 'DEFINES' AS predicate, step AS object, TRUE AS resolved, 1.0 AS confidence FROM s
 UNION ALL SELECT file, step, 'QUERIES_DATABASE', 'Table:t' || (pos % 3), TRUE, 1.0 FROM s WHERE t = 'view'
 UNION ALL SELECT file, step, 'WRITES_DATABASE', 'Table:t' || (pos % 4), TRUE, 0.9 FROM s WHERE t IN ('purchase', 'click')
 UNION ALL SELECT file, step, 'WRITES_TO_S3', 'S3Object:s3://bucket/' || pos, FALSE, 0.4 FROM s WHERE t = 'error'
 UNION ALL SELECT DISTINCT file, coalesce(producer, 'Dataframe:' || df), 'FEEDS', step, producer IS NOT NULL, CASE WHEN producer IS NULL THEN 0.5 ELSE 1.0 END FROM fed WHERE role = 'in')"""


def _workflows(v) -> DataFrame:
    return D.workflow_steps(D.as_json(_doc(v("events"), "concat('w', user_id % 50)", "event_id", _ACTION, "actions:\n", "\n", "\n")))


@query("i13_workflow_steps", f"WITH {_FLOWS} SELECT file, (row_number() OVER (PARTITION BY file ORDER BY pos) - 1)::INTEGER AS pos, step, CASE t WHEN 'view' THEN 'EXTRACT' WHEN 'signup' THEN 'TRANSFORM' WHEN 'error' THEN 'ODD' ELSE 'LOAD' END AS action FROM s")
def i13(v):
    return _workflows(v).drop("body")


@query("i13_workflow_facts", f"WITH {_FLOWS} SELECT file, subject, predicate, object, resolved, confidence::DOUBLE AS confidence FROM e")
def i13b(v):
    return D.workflow_facts(_workflows(v))


@query("i14_fixture_paths", "SELECT 'e' || p_size AS file, 'input_payload/' || p_partkey || '.json' AS path FROM part UNION ALL SELECT 'e' || p_size, 'expected_output_payload/x' || p_partkey FROM part WHERE p_partkey % 3 = 0")
def i14(v):
    row = "concat('  | fn', p_partkey, ' | unit | ', p_partkey, '.json | x', p_partkey, ' | ', CASE WHEN p_partkey % 3 = 0 THEN 'Full-Comparison' ELSE 'keys' END, ' |')"
    head = "Examples:\n | lambda_name | kind | input | output | how |\n"
    return D.fixture_paths(_doc(v("part"), "concat('e', p_size)", "p_partkey", row, head, "\n | short | row |\nThe end", "\n")).select("file", "path")


@query("i15_coverage_rows", "SELECT 'c' || n_regionkey AS file, n_name AS section, n_nationkey::VARCHAR AS real, '1' AS stub, '2' AS gap, 'ok' AS verdict FROM nation")
def i15(v):
    row = "concat('| ', n_name, ' | ', n_nationkey, ' | 1 | 2 | ok |')"
    text = _doc(v("nation"), "concat('c', n_regionkey)", "n_nationkey", row, "# Cover\n\n| Section | Real | Stub | Gap | Verdict |\n|---|---|---|---|---|\n| cut | 1 |\n", "\n\n| after | 1 | 2 | 3 | no |\n", "\n")
    return D.coverage_rows(text).select("file", "section", "real", "stub", "gap", "verdict")


@query("l01_label", "SELECT DISTINCT left(sha256('2' || p_type), 12) AS fingerprint, CASE WHEN p_size_max % 2 = 0 THEN 'kept' ELSE upper(p_type) END AS label FROM (SELECT p_type, max(p_size) AS p_size_max FROM part GROUP BY p_type) x")
def l01(v):
    def shout(frames):
        for pdf in frames:
            yield pdf.assign(label=pdf["text"].str.upper())[["fingerprint", "label"]]

    texts = v("part").selectExpr("p_type AS text")
    known = v("part").groupBy("p_type").agg(F.max("p_size").alias("n")).filter("n % 2 = 0").select(F.sha2(F.concat(F.lit("2"), "p_type"), 256).alias("fingerprint"), F.lit("kept").alias("label"))
    return M.label(texts, shout, known, "2").select(F.left("fingerprint", F.lit(12)).alias("fingerprint"), "label")


@query("l02_coverage_assist", "WITH m AS (SELECT id FROM profiles WHERE side = 'ref' AND id % 3 <> 0), g AS (SELECT id FROM profiles WHERE side = 'cand') SELECT 'credited' AS kind, m.id FROM m WHERE id % 2 = 0 AND id + 1 IN (SELECT id FROM g) UNION ALL SELECT 'redundant', id FROM g WHERE id % 5 = 0")
def l02(v):
    ref, cand = _sides(v)

    def ask(missing, generated):
        """Stands for the assistant: claims some credits, not all of them for rows that exist, and calls some rows redundant."""
        credits = missing.select("id", (F.col("id") + 1).alias("by"), (F.col("id") % 2 == 0).alias("covers")).withColumnsRenamed({"id": "manual", "by": "generated"})
        return credits, generated.filter("id % 5 = 0").select("id").unionByName(generated.select((-F.col("id") - 1).alias("id")))

    credited, redundant, _ = M.coverage_assist(ref, cand, ref.filter("id % 3 = 0").select(F.col("id").alias("ref_id")), ask)
    return credited.select(F.lit("credited").alias("kind"), F.col("manual").alias("id")).unionByName(redundant.select(F.lit("redundant").alias("kind"), "id"))
