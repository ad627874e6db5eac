"""Queries for enrichment joins and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import enrich as N
from ..operators import graph as G
from ..operators import quality as Q
from .q_graph import ENTRY, FLOW, INDEG, WALKS, _in
from .registry import query

# every ninth entity lies in a bare file, every seventh has no file
_PLACED = "placed AS (SELECT app_id, id, type, name, language, CASE WHEN length(id) % 9 = 0 THEN name || '.py' WHEN length(id) % 7 <> 0 THEN file_path END AS file_path FROM entities)"
COMP = f"{_PLACED}, comp AS (SELECT app_id, component, coalesce(list_sort(list(DISTINCT language)), []) AS languages, arg_min(prefix, id) AS prefix, count(*) AS entity_count FROM (SELECT *, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 2) ELSE '_unassigned' END AS component, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) ELSE '' END AS prefix FROM placed) x GROUP BY app_id, component)"


def _placed(v):
    return v("entities").withColumn("file_path", F.expr("CASE WHEN length(id) % 9 = 0 THEN concat(name, '.py') WHEN length(id) % 7 <> 0 THEN file_path END"))


@query("e01_infer_components", f"WITH {COMP} SELECT * FROM comp UNION ALL SELECT 'bare', 'default', [], '', 0")
def e01(v):
    e = _placed(v)
    return N.infer_components(e, e.select("app_id").unionByName(v("region").selectExpr("CASE WHEN r_regionkey = 0 THEN 'core' ELSE 'bare' END AS app_id")))


# components of another layout: a prefix inside names (method, method2), one that only its name finds, and one last of all
_DECLARED = "declared AS (SELECT 'core' AS app_id, 'core/meth' AS prefix, 'aa' AS component UNION ALL SELECT 'core', 'core/step', 'bb' UNION ALL SELECT 'core', 'elsewhere/x', 'functi' UNION ALL SELECT 'core', 'core/st', 'zz' UNION ALL SELECT 'core', '', '_unassigned' UNION ALL SELECT 'events', 'none/at/all', 'only')"
_ASSIGN = "SELECT e.app_id, e.id, CASE WHEN coalesce(file_path, '') = '' THEN coalesce((SELECT min(component) FROM {c} c WHERE c.app_id = e.app_id AND component IN ('_unassigned', e.app_id)), l.last) ELSE coalesce((SELECT min(component) FROM {c} c WHERE c.app_id = e.app_id AND prefix <> '' AND starts_with(e.file_path, c.prefix)), (SELECT min(component) FROM {c} c WHERE c.app_id = e.app_id AND component = split_part(e.file_path, '/', 2) AND contains(e.file_path, '/')), l.last) END AS component FROM placed e JOIN (SELECT app_id, arg_max(component, (prefix = '', component)) AS last FROM {c} GROUP BY app_id) l USING (app_id)"


@query("d02_assign_components", f"WITH {COMP} {_ASSIGN.format(c='comp')}")
def d02(v):
    e = G.stage(_placed(v), "entities")
    return N.assign_components(e, N.infer_components(e)).select("app_id", "id", "component")


@query("d02_declared_components", f"WITH {COMP}, {_DECLARED} {_ASSIGN.format(c='declared')}")
def d02b(v):
    rows = "CASE n_nationkey WHEN 0 THEN array('core', 'core/meth', 'aa') WHEN 1 THEN array('core', 'core/step', 'bb') WHEN 2 THEN array('core', 'elsewhere/x', 'functi') WHEN 3 THEN array('core', 'core/st', 'zz') WHEN 4 THEN array('core', '', '_unassigned') WHEN 5 THEN array('events', 'none/at/all', 'only') END AS c"
    c = v("nation").selectExpr(rows).filter("c IS NOT NULL").selectExpr("c[0] AS app_id", "c[1] AS prefix", "c[2] AS component")
    return N.assign_components(G.stage(_placed(v), "entities"), c).select("app_id", "id", "component")


@query("d03_bucket_edges", "SELECT DISTINCT object AS subject, 'IN_BUCKET' AS predicate, 'S3Object:' || split_part(substring(object, 10), '/', 1) AS object FROM facts WHERE object LIKE 'S3Object:click/%' OR object LIKE 'S3Object:view/%'")
def d03(v):
    b = v("events").filter("event_type IN ('click', 'view')").select(F.col("event_type").alias("bucket")).distinct()
    return N.bucket_edges(v("facts"), b)


@query("d04_link_handlers", "SELECT 'L' || s_suppkey AS lambda, 'h' || (s_suppkey % 7) || '.main' AS handler, CASE WHEN n = 1 THEN one_name ELSE NULL END AS function, CASE WHEN n = 1 THEN 1.0 END AS confidence, c AS candidates FROM supplier LEFT JOIN (SELECT k, count(*) AS n, min(name) AS one_name, list_sort(list(name)) AS c FROM (SELECT DISTINCT n_nationkey % 7 AS k, 'pkg' || (n_nationkey % 14) || '.h' || (n_nationkey % 7) || '.main' AS name FROM nation WHERE n_nationkey % 7 <> 3) x GROUP BY k) y ON s_suppkey % 7 = k".replace("c AS candidates", "coalesce(c, []) AS candidates"))
def d04(v):
    h = v("supplier").selectExpr("concat('L', s_suppkey) AS lambda", "concat('h', s_suppkey % 7, '.main') AS handler")
    f = v("nation").filter("n_nationkey % 7 <> 3").selectExpr("concat('pkg', n_nationkey % 14, '.h', n_nationkey % 7, '.main') AS name").distinct()
    return N.link_handlers(h, f, v("region").selectExpr("concat('L', r_regionkey) AS lambda", "'none' AS hint"))


@query("d04_link_handlers_hint", "SELECT 'L' || s_suppkey AS lambda, 'pkg' || (s_suppkey % 2) || '.job.main' AS function, 0.9 AS confidence FROM supplier")
def d04b(v):
    h = v("supplier").selectExpr("concat('L', s_suppkey) AS lambda", "'job.main' AS handler")
    f = v("region").filter("r_regionkey < 2").selectExpr("concat('pkg', r_regionkey, '.job.main') AS name")
    hints = v("supplier").selectExpr("concat('L', s_suppkey) AS lambda", "concat('deploy/pkg', s_suppkey % 2, '/x') AS hint")
    return N.link_handlers(h, f, hints).select("lambda", "function", "confidence")


@query("d05_implementation_edges", "SELECT DISTINCT 'Method:I' || n_regionkey || '.m' || (n_nationkey % 3) AS subject, 'IMPLEMENTED_BY' AS predicate, 'Method:C' || n_nationkey || '.m' || (n_nationkey % 3) AS object FROM nation WHERE n_nationkey % 5 <> 0")
def d05(v):
    n = v("nation")
    rows = n.selectExpr("concat('Class:C', n_nationkey) AS subject", "'IMPLEMENTS' AS predicate", "concat('Class:I', n_regionkey) AS object", "n_nationkey % 5 <> 0 AS resolved")
    rows = rows.unionByName(n.selectExpr("concat('Class:C', n_nationkey) AS subject", "'DEFINES' AS predicate", "concat('Method:C', n_nationkey, '.m', n_nationkey % 3) AS object", "true AS resolved"))
    iface = n.select("n_regionkey").distinct().selectExpr("n_regionkey", "explode(array(0, 1, 2)) AS m").selectExpr("concat('Class:I', n_regionkey) AS subject", "'DEFINES' AS predicate", "concat('Method:I', n_regionkey, '.m', m) AS object", "true AS resolved")
    return N.implementation_edges(rows.unionByName(iface))


@query("d06_config_sql_facts", "WITH j AS (SELECT DISTINCT 'Function:f' || s_suppkey AS f, p_brand AS k, p_size % 2 = 0 AS w, p_type AS t FROM supplier JOIN part ON p_brand = 'Brand#' || (s_suppkey % 20)) SELECT DISTINCT f AS subject, CASE WHEN w THEN 'WRITES_DATABASE' ELSE 'QUERIES_DATABASE' END AS predicate, 'Table:' || t AS object FROM j UNION SELECT f, 'READS_FILE', 'conf/' || k FROM j")
def d06(v):
    c = v("part").selectExpr("p_brand AS key", "concat('conf/', p_brand) AS file", "p_type AS table", "p_size % 2 = 0 AS is_write")
    return N.config_sql_facts(c, v("supplier").selectExpr("concat('Function:f', s_suppkey) AS function", "concat('Brand#', s_suppkey % 20) AS value"))


@query("d07_competing_files", "WITH s AS (SELECT DISTINCT p_brand AS file, p_type AS key, CAST(p_size % 3 AS VARCHAR) AS value FROM part) SELECT DISTINCT a.file FROM s a JOIN s b ON a.key = b.key AND a.value <> b.value JOIN s c ON a.key = c.key AND a.file <> c.file WHERE a.file NOT IN (SELECT p_brand FROM part WHERE p_partkey = 1)")
def d07(v):
    s = v("part").selectExpr("p_brand AS file", "p_type AS key", "cast(p_size % 3 as string) AS value").distinct()
    return N.competing_files(s, v("part").filter("p_partkey = 1").select(F.col("p_brand").alias("file")))


@query("d19_handoffs", f"SELECT object FROM facts WHERE predicate IN {_in(vocab.WRITES)} INTERSECT SELECT object FROM facts WHERE predicate IN {_in(vocab.READS)}")
def d19(v):
    return N.handoffs(v("facts"))


@query("d19_stranded", f"SELECT DISTINCT object FROM templated WHERE predicate IN {_in(vocab.WRITES + vocab.READS)} AND contains(object, '$' || chr(123))")
def d19b(v):
    return N.stranded(v("templated"))


@query("d21_verify_facts", "WITH m AS (SELECT max(doc_id) + 1 AS m FROM documents), n AS (SELECT doc_id, max(pos) + 1 AS n FROM doc_lines GROUP BY doc_id), c AS (SELECT event_id AS id, event_id % m AS file, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id * 7919 % coalesce(n, 1) END AS line, event_type AS name FROM events CROSS JOIN m LEFT JOIN n ON doc_id = event_id % m) SELECT id, CASE WHEN line IS NOT NULL THEN coalesce((SELECT bool_or(contains(lower(l.line), lower(c.name))) FROM doc_lines l WHERE l.doc_id = c.file AND l.pos BETWEEN c.line - 3 AND c.line + 3), FALSE) END AS verified FROM c")
def d21(v):
    return N.verify_facts(_claims(v), v("doc_lines").selectExpr("doc_id AS file", "pos", "line AS text"))


_WORDED = "SELECT doc_id, pos, doc_id * 100000 + pos AS id, regexp_replace({split}, '[^a-z]', ''{all}) AS w FROM doc_lines"


# every predicate with a rule of its own, one without, a file that isn't there and a fact without a file
_PREDICATES = ("CALLS", "USES", "READS_ENV_VAR", "FEEDS", "EXPOSES_ENDPOINT", "DEFINES", "QUERIES_DATABASE", "WRITES_TO_S3", "INVOKES_LAMBDA", "GONE", "NONE")
_RULE = """CASE kind WHEN 0 THEN contains(win, w) WHEN 1 THEN CASE WHEN w <> '' THEN contains(win, w) END WHEN 2 THEN contains(win, w) AND (contains(win, 'environ') OR contains(win, 'getenv')) WHEN 3 THEN contains(win, 'zzzz') OR contains(win, w)
 WHEN 4 THEN contains(win, '/v1/' || w) OR (contains(win, CASE WHEN length(w) > 2 THEN w ELSE '/v1/' || w END) AND (contains(lower(win), 'route') OR contains(win, '@'))) WHEN 5 THEN contains(win, w)
 WHEN 6 THEN contains(win, w) OR regexp_matches(win, 'session|\\.query\\(|\\.add\\(|\\.filter|execute|__tablename__') OR regexp_matches(upper(win), 'INSERT|SELECT|UPDATE|DELETE FROM') WHEN 7 THEN regexp_matches(win, 'get_object|put_object|upload|download|s3|S3|boto3') WHEN 8 THEN contains(win, 'invoke') OR contains(win, w) WHEN 9 THEN FALSE END"""
_REASON = "CASE kind WHEN 0 THEN 'callee name present' WHEN 2 THEN 'env read present' WHEN 3 THEN 'lineage endpoint present' WHEN 4 THEN CASE WHEN contains(win, '/v1/' || w) THEN 'endpoint path present' ELSE 'endpoint (blueprint suffix)' END WHEN 5 THEN 'definition present' WHEN 6 THEN 'table/sql/ORM present' WHEN 7 THEN 's3 op present' WHEN 8 THEN 'lambda invoke present' WHEN 9 THEN 'file not found: -1' WHEN 10 THEN 'no file:line on fact' ELSE 'generic token present' END"


@query("d21_check_facts", f"WITH c AS ({_WORDED.format(split="split_part(line, ' ', 2)", all=", 'g'")}), t AS (SELECT c.*, pos % 11 AS kind, pos + 1 + pos % 9 AS line FROM c), x AS (SELECT t.*, coalesce((SELECT string_agg(l.line, chr(10) ORDER BY l.pos) FROM doc_lines l WHERE l.doc_id = t.doc_id AND l.pos BETWEEN t.line - 4 AND t.line + 2), '') AS win FROM t) SELECT id, {_RULE} AS verified, {_REASON} AS reason FROM x")
def d21b(v):
    rows = v("doc_lines").select("doc_id", "pos", (F.col("doc_id") * 100000 + F.col("pos")).alias("id"), F.regexp_replace(F.split_part("line", F.lit(" "), F.lit(2)), "[^a-z]", "").alias("w"))
    predicate = F.element_at(F.array(*[F.lit(p) for p in _PREDICATES]), (F.col("pos") % 11 + 1).cast("int"))
    obj = "CASE pos % 11 WHEN 0 THEN concat('Function:m.', w, ' (why)') WHEN 1 THEN concat('a::', w) WHEN 2 THEN w WHEN 4 THEN concat('APIEndpoint:GET /v1/', w) WHEN 5 THEN concat('Class:m.', w) WHEN 6 THEN concat('Table:db.${', w, '}') WHEN 7 THEN concat('S3Object:b/', w) WHEN 8 THEN concat('LambdaFunction:', w) ELSE concat('y::', w) END AS object"
    claims = rows.withColumn("predicate", predicate).selectExpr("id", "'x::zzzz' AS subject", "predicate", obj, "CASE pos % 11 WHEN 9 THEN -1 WHEN 10 THEN NULL ELSE doc_id END AS file", "pos + 1 + pos % 9 AS line")
    return N.check_facts(claims, v("doc_lines").selectExpr("doc_id AS file", "pos", "line AS text"))


def _claims(v):
    m = v("documents").agg((F.max("doc_id") + 1).alias("m"))
    n = v("doc_lines").groupBy("doc_id").agg((F.max("pos") + 1).alias("n"))
    e = v("events").crossJoin(F.broadcast(m)).withColumn("file", F.expr("event_id % m")).join(n, F.col("file") == F.col("doc_id"), "left")
    return e.selectExpr("event_id AS id", "file", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id * 7919 % coalesce(n, 1) END AS line", "CASE WHEN event_type = 'x' THEN '' ELSE event_type END AS name")


@query("e12_grade", "WITH c AS (SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE value > 50 END AS verified FROM events) SELECT count(*) FILTER (verified) AS kept, count(*) FILTER (NOT verified) AS rejected, count(*) FILTER (verified IS NULL) AS uncheckable, round(100.0 * count(*) FILTER (verified) / count(*) FILTER (verified IS NOT NULL), 1) AS precision FROM c")
def e12(v):
    return N.grade(v("events").selectExpr("CASE WHEN event_id % 9 = 0 THEN NULL ELSE value > 50 END AS verified"))


@query("e12_rejects", "SELECT id FROM (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value > 50 END AS verified FROM events) x WHERE NOT verified ORDER BY id LIMIT 10")
def e12b(v):
    return N.rejects(v("events").selectExpr("event_id AS id", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value > 50 END AS verified")).select("id")


@query("e34_routing_stats", "SELECT CASE WHEN event_id % 9 = 0 THEN 'note' WHEN value > 50 THEN 'verified' ELSE 'rejected' END AS destination, count(*) AS n FROM events GROUP BY ALL")
def e34(v):
    return Q.routing_stats(v("events").selectExpr("CASE WHEN event_id % 9 = 0 THEN NULL ELSE value > 50 END AS verified"))


@query("d22_topology_edges", "SELECT DISTINCT 'user:' || user_id AS src, 'type:' || event_type AS dst, 'k' || (user_id % 3) AS kind FROM events WHERE user_id % 3 < 2")
def d22(v):
    f = v("events").selectExpr("concat('k', user_id % 3) AS kind", "cast(user_id as string) AS src", "event_type AS dst")
    return N.topology_edges(f, v("region").filter("r_regionkey < 2").selectExpr("concat('k', r_regionkey) AS kind", "'user' AS src_kind", "'type' AS dst_kind"))


@query("d23_enrich_nodes", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'L2' ELSE 'L1' END AS tier, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE 'core' END AS kind FROM customer")
def d23(v):
    c = v("customer")
    return N.enrich_nodes(c.selectExpr("c_custkey AS id"), c.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "'L2' AS tier", "lower(c_mktsegment) AS kind"))


@query("d24_resolve_calls", "SELECT c_custkey AS caller, 'fn' || (c_nationkey % 10) AS callee, CASE WHEN n = 1 THEN 'Function:' || name ELSE 'Symbol:fn' || (c_nationkey % 10) END AS target, CASE WHEN n = 1 THEN 1.0 ELSE 0.5 END AS confidence FROM customer JOIN (SELECT k, count(*) AS n, min(name) AS name FROM (SELECT n_nationkey % 18 AS k, 'mod' || n_nationkey || '.fn' || (n_nationkey % 18) AS name FROM nation WHERE n_nationkey % 18 <> 4) x GROUP BY k) y ON c_nationkey % 10 = k")
def d24(v):
    return N.resolve_calls(v("customer").selectExpr("c_custkey AS caller", "concat('fn', c_nationkey % 10) AS callee"), v("nation").filter("n_nationkey % 18 <> 4").selectExpr("concat('mod', n_nationkey, '.fn', n_nationkey % 18) AS name"))


@query("d25_step_lineage", "WITH s AS (SELECT user_id % 50 AS file, event_id AS pos, 's' || event_id AS step, CASE WHEN event_type IN ('view', 'signup') THEN 'out' ELSE 'in' END AS role, 'df' || (user_id % 7) AS df FROM events), w AS (SELECT *, last_value(CASE WHEN role = 'out' THEN step END IGNORE NULLS) OVER (PARTITION BY file, df ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS producer FROM s) SELECT DISTINCT coalesce(producer, 'Dataframe:' || df) AS source, step, file, CASE WHEN producer IS NOT NULL THEN 1.0 ELSE 0.5 END AS confidence FROM w WHERE role = 'in'")
def d25(v):
    s = v("events").selectExpr("user_id % 50 AS file", "event_id AS pos", "concat('s', event_id) AS step", "CASE WHEN event_type IN ('view', 'signup') THEN 'out' ELSE 'in' END AS role", "concat('df', user_id % 7) AS df")
    return N.step_lineage(s)


@query("d28_spec_status", "SELECT DISTINCT object AS entry, CASE WHEN object LIKE '%A%' THEN 'covered' ELSE 'missing' END AS status FROM facts WHERE predicate = 'EXPOSES_ENDPOINT'")
def d28(v):
    d = G.doors(v("facts"))
    return Q.spec_status(d, d.filter("entry LIKE '%A%'").select(F.col("entry").alias("unit")))


@query("d29_check_added", "SELECT p_partkey AS id, 'Table:part.' || p_partkey AS start FROM part WHERE p_partkey % 2 = 0 AND 'Table:part.' || p_partkey IN (SELECT object FROM facts)")
def d29(v):
    return Q.check_added(v("part").selectExpr("p_partkey AS id", "concat(CASE WHEN p_partkey % 2 = 0 THEN 'Table:part.' ELSE 'Table:gone.' END, p_partkey) AS start"), v("facts")).select("id", "start")


# brands are names: values files hold nested maps for some and something unreadable for others, a later file replaces an earlier one's
_CONFIG = """config AS (SELECT p_partkey AS ord, CASE WHEN p_size % 4 < 2 THEN 'values' WHEN p_size % 4 = 2 THEN 'variable' ELSE 'local' END AS kind, p_brand AS root, CASE WHEN p_size % 4 = 1 THEN p_type ELSE '' END AS hop, p_name AS value, p_partkey % 3 <> 0 AS is_literal FROM part
 UNION ALL SELECT s_suppkey, 'resource', 'aws_lambda_function', 's' || s_suppkey, s_name, s_suppkey % 5 <> 0 FROM supplier)"""


@query("d30_resolve_refs", f"""WITH {_CONFIG}, kept AS (SELECT * FROM config WHERE kind NOT IN ('variable', 'local') OR is_literal), last AS (SELECT * FROM kept k WHERE kind = 'resource' OR ord = (SELECT max(ord) FROM kept m WHERE m.kind = k.kind AND m.root = k.root)),
 asked AS (SELECT DISTINCT 'var.' || p_brand AS ref, p_brand AS root, '' AS hop, 'var' AS what FROM part UNION SELECT DISTINCT 'var.' || p_brand || '["' || p_type || '"]', p_brand, p_type, 'var' FROM part UNION SELECT DISTINCT 'local.' || p_brand, p_brand, '', 'local' FROM part UNION SELECT 'aws_lambda_function.s' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.arn' WHEN 1 THEN '.function_name' ELSE '.memory' END, 'aws_lambda_function', 's' || s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 'resource' ELSE 'none' END FROM supplier UNION SELECT 'plain' || r_regionkey, '', '', 'none' FROM region),
 chosen AS (SELECT *, CASE WHEN what <> 'var' THEN what WHEN EXISTS (SELECT 1 FROM last l WHERE l.kind = 'values' AND l.root = a.root) THEN 'values' ELSE 'variable' END AS kind FROM asked a)
 SELECT ref, (SELECT l.value FROM last l WHERE l.is_literal AND l.kind = c.kind AND l.root = c.root AND l.hop = c.hop) AS value FROM chosen c""")
def d30(v):
    p, s = v("part"), v("supplier")
    rows = p.selectExpr("p_partkey AS ord", "CASE WHEN p_size % 4 < 2 THEN 'values' WHEN p_size % 4 = 2 THEN 'variable' ELSE 'local' END AS kind", "CASE WHEN p_size % 4 = 1 THEN array(p_brand, p_type) ELSE array(p_brand) END AS path", "p_name AS value", "p_partkey % 3 <> 0 AS is_literal")
    rows = rows.unionByName(s.selectExpr("s_suppkey AS ord", "'resource' AS kind", "array('aws_lambda_function', concat('s', s_suppkey), 'function_name') AS path", "s_name AS value", "s_suppkey % 5 <> 0 AS is_literal"))
    refs = p.selectExpr("explode(array(concat('var.', p_brand), concat('var.', p_brand, '[\"', p_type, '\"]'), concat('local.', p_brand))) AS ref").distinct()
    refs = refs.unionByName(s.selectExpr("concat('aws_lambda_function.s', s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '.arn' WHEN 1 THEN '.function_name' ELSE '.memory' END) AS ref")).unionByName(v("region").selectExpr("concat('plain', r_regionkey) AS ref"))
    return N.resolve_refs(rows, refs)


@query("e37_merge_declarations", "SELECT p_brand AS name, arg_min(p_name, p_partkey) AS handler, (SELECT list(t ORDER BY o) FROM (SELECT p_type AS t, min(p_partkey) AS o FROM part q WHERE q.p_brand = p.p_brand GROUP BY p_type) z) AS hints, arg_min(p_size::VARCHAR, p_partkey) AS size, arg_min(p_partkey::VARCHAR, p_partkey) FILTER (p_partkey % 2 = 0) AS even FROM part p GROUP BY p_brand")
def e37(v):
    settings = "CASE WHEN p_partkey % 2 = 0 THEN map('size', string(p_size), 'even', string(p_partkey)) ELSE map('size', string(p_size)) END AS settings"
    out = N.merge_declarations(v("part").selectExpr("p_partkey AS ord", "p_brand AS name", "p_name AS handler", "p_type AS hint", settings))
    return out.select("name", "handler", "hints", F.col("settings")["size"].alias("size"), F.col("settings")["even"].alias("even"))


@query("f09_canonical_order", "SELECT ord, file_path, coalesce(line, 0) AS line FROM facts")
def f09(v):
    return N.canonical_order(v("facts")).select("ord", "file_path", F.coalesce("line", F.lit(0)).alias("line"))


@query("e03_node_counts", "SELECT split_part(n, ':', 1) AS type, count(*) AS nodes FROM (SELECT subject AS n FROM facts UNION SELECT object FROM facts) x GROUP BY 1")
def e03(v):
    return Q.node_counts(v("facts"))


@query("e04_edge_counts", "SELECT predicate, count(*) AS n FROM facts GROUP BY predicate")
def e04(v):
    return Q.edge_counts(v("facts"))


@query("e05_row_counts", "SELECT 'facts' AS table_name, count(*) AS n, 'PASS' AS verdict FROM facts WHERE app_id = 'core' UNION ALL SELECT 'entities', count(*), 'PASS' FROM entities WHERE app_id = 'core'")
def e05(v):
    return Q.row_counts({"facts": v("facts"), "entities": v("entities")}, "core")


@query("e06_duplicate_facts", "SELECT app_id, count(*) - count(DISTINCT (subject, predicate, object)) AS duplicates FROM facts GROUP BY app_id")
def e06(v):
    return Q.duplicate_facts(v("facts"))


@query("e07_unresolved", r"SELECT app_id, count(*) FILTER (NOT resolved) AS unresolved, count(*) FILTER (contains(object, '${')) AS placeholders, (SELECT count(DISTINCT t) FROM (SELECT app_id, unnest(regexp_extract_all(object, '\$\{([^}]+)\}', 1)) AS t FROM templated) y WHERE y.app_id = x.app_id) AS tokens FROM templated x GROUP BY app_id")
def e07(v):
    return Q.unresolved(v("templated"))


_SNAP = f"SELECT app_id, count(*) AS facts, count(*) FILTER (resolved) AS resolved, count(*) FILTER (predicate IN {_in(vocab.WRITES)}) AS writes, count(*) FILTER (predicate IN {_in(vocab.READS)}) AS reads, count(*) FILTER (predicate IN {_in(vocab.ENTRIES)}) AS entries, count(*) FILTER (predicate = 'CALLS') AS calls, count(*) FILTER (extraction_method = 'human') AS human, count(*) FILTER (confidence IS NULL) AS no_confidence, count(*) FILTER (line IS NULL) AS no_line, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects, count(DISTINCT file_path) AS files FROM facts"


@query("e08_snapshot", f"{_SNAP} GROUP BY app_id")
def e08(v):
    return Q.snapshot(v("facts"))


@query("e08_run_measures", "WITH f AS (SELECT app_id, count(*) AS facts, count(*) FILTER (NOT resolved) AS unresolved_facts, count(DISTINCT object) FILTER (predicate IN ('QUERIES_DATABASE', 'WRITES_DATABASE')) AS tables FROM (SELECT app_id, predicate, object, resolved FROM facts UNION ALL SELECT app_id, predicate, object, resolved FROM templated) x GROUP BY app_id), b AS (SELECT app_id, count(DISTINCT t) AS blank_names FROM (SELECT app_id, unnest(regexp_extract_all(object, '[$][{]([^}]+)[}]', 1)) AS t FROM templated) x GROUP BY app_id), k AS (SELECT app_id, count(*) AS entities, count(*) FILTER (type = 'Journey') AS journeys, count(*) FILTER (type = 'BehaviorGroup') AS behavior_groups FROM (SELECT app_id, CASE WHEN length(id) % 5 = 0 THEN 'Journey' WHEN length(id) % 7 = 0 THEN 'BehaviorGroup' ELSE type END AS type FROM entities) x GROUP BY app_id), m AS (SELECT app_id, count(*) AS n FROM feedback GROUP BY app_id UNION ALL VALUES ('core', 2), ('events', 0)) SELECT app_id, n AS questions_open, n AS human_answers, 0::BIGINT AS decisions, 1::BIGINT AS unwired, 0::BIGINT AS lambdas_unlinked, coalesce(facts, 0) AS facts, coalesce(unresolved_facts, 0) AS unresolved_facts, 0::BIGINT AS web_calls, 0::BIGINT AS secrets, 0::BIGINT AS parameters, coalesce(tables, 0) AS tables, 0::BIGINT AS lambda_links, coalesce(blank_names, 0) AS blank_names, coalesce(entities, 0) AS entities, coalesce(journeys, 0) AS journeys, coalesce(behavior_groups, 0) AS behavior_groups FROM m LEFT JOIN f USING (app_id) LEFT JOIN b USING (app_id) LEFT JOIN k USING (app_id)")
def e08b(v):
    columns = ["app_id", "predicate", "object", "resolved"]
    n = v("feedback").groupBy("app_id").agg(F.count("*").alias("n")).unionByName(v("facts").select("app_id").distinct().select("app_id", F.when(F.col("app_id") == "core", 2).otherwise(0).cast("long").alias("n")))
    many = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda x: x.cast("string")))
    m = n.select("app_id", many.alias("pending_names"), F.map_from_arrays(many, many).alias("human_answers"), F.lit(None).cast("map<string,string>").alias("decisions"), F.array(F.lit("x")).alias("unwired"), F.array().cast("array<string>").alias("handler_unlinked"))
    kind = F.expr("CASE WHEN length(id) % 5 = 0 THEN 'Journey' WHEN length(id) % 7 = 0 THEN 'BehaviorGroup' ELSE type END")
    return Q.run_measures(v("facts").select(*columns).unionByName(v("templated").select(*columns)), v("entities").withColumn("type", kind), m)


@query("e10_capture_objects", f"SELECT family, object, bool_or(config) AS from_config, bool_or(NOT config) AS from_code, bool_or(resolved) AS readable FROM (SELECT CASE WHEN predicate IN {_in(vocab.WRITES)} THEN 'writes' WHEN predicate IN {_in(vocab.READS)} THEN 'reads' END AS family, object, resolved, ord % 3 = 0 AS config FROM facts) x WHERE family IS NOT NULL GROUP BY family, object")
def e10b(v):
    f = v("facts").withColumn("subject", F.expr("CASE WHEN ord % 3 = 0 THEN concat('ConfigFile:', ord) ELSE subject END"))
    return Q.capture_objects(f, {"writes": vocab.WRITES, "reads": vocab.READS})


@query("e09_snapshot_diff", f"WITH a AS (UNPIVOT ({_SNAP} WHERE ord % 3 <> 0 GROUP BY app_id) ON COLUMNS(* EXCLUDE app_id) INTO NAME measure VALUE old), b AS (UNPIVOT ({_SNAP} GROUP BY app_id) ON COLUMNS(* EXCLUDE app_id) INTO NAME measure VALUE new) SELECT app_id, measure, old, new FROM a FULL JOIN b USING (app_id, measure) WHERE old IS DISTINCT FROM new")
def e09(v):
    f = v("facts")
    return Q.snapshot_diff(Q.snapshot(f.filter("ord % 3 <> 0")), Q.snapshot(f))


@query("e10_capture_inventory", f"SELECT family, count(*) AS n, min(object) AS first, max(object) AS last, count(*) AS readable FROM (SELECT DISTINCT CASE WHEN predicate IN {_in(vocab.WRITES)} THEN 'writes' WHEN predicate IN {_in(vocab.READS)} THEN 'reads' WHEN predicate IN {_in(vocab.ENTRIES)} THEN 'entries' END AS family, object FROM facts) x WHERE family IS NOT NULL GROUP BY family")
def e10(v):
    return Q.capture_inventory(v("facts"))


@query("e11_reach", f"WITH RECURSIVE {FLOW}, {INDEG}, {ENTRY}, {WALKS} SELECT count(*) AS starts, avg(n) AS average, count(*) FILTER (n = 0) AS nothing FROM (SELECT e.node, (SELECT count(*) FROM walks w WHERE w.entry = e.node) AS n FROM entry e) x")
def e11(v):
    g = G.flow(v("facts"))
    starts = G.entries(g)
    return Q.reach(G.sizes(G.spread(g.edges, starts)), starts)


@query("e23_doc_completeness", "SELECT 'u' || p_partkey AS unit, list_sort(list_filter(['confidence mapping', 'consolidated requirements', 'function specification', 'input specification', 'output specification', 'system overview', 'traceability matrix', CASE WHEN p_size % 2 = 0 THEN 'user stories' END, CASE WHEN p_size % 3 = 0 THEN 'gap analysis' END], lambda x: x IS NOT NULL)) AS missing FROM part")
def e23(v):
    m = F.create_map(F.lit("6. User Stories"), F.when(F.col("p_size") % 2 == 0, " ").otherwise("text"), F.lit("Gap Analysis"), F.when(F.col("p_size") % 3 == 0, "").otherwise("text"))
    return Q.doc_completeness(v("part").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("unit"), m.alias("sections")))


@query("e23_check_manifest", "SELECT * FROM (SELECT 'u' || p_partkey AS unit, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'no reason for the skip' END WHEN p_size % 4 = 1 THEN 'no doc_file' WHEN p_partkey % 3 = 0 THEN 'doc_file not found: d' || p_partkey ELSE 'missing canonical sections: System Overview, Input Specification, Consolidated Requirements, Output Specification, Function Specification, ' || CASE WHEN p_size % 2 = 0 THEN 'User Stories, ' ELSE '' END || 'Traceability Matrix, Confidence Mapping' || CASE WHEN p_size % 3 = 0 THEN ', Gap Analysis' ELSE '' END END AS problem FROM part) x WHERE problem IS NOT NULL")
def e23b(v):
    p = v("part")
    m = F.create_map(F.lit("6. User Stories"), F.when(F.col("p_size") % 2 == 0, " ").otherwise("text"), F.lit("gap analysis"), F.when(F.col("p_size") % 3 == 0, "").otherwise("text"))
    entries = p.selectExpr("concat('u', p_partkey) AS unit", "CASE WHEN p_size % 4 = 0 THEN 'skipped' ELSE 'documented' END AS status", "CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE 'small' END AS reason", "CASE WHEN p_size % 4 <> 1 THEN concat('d', p_partkey) END AS doc_file")
    return Q.check_manifest(entries, p.filter("p_partkey % 3 <> 0").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("doc_file"), m.alias("sections")))


@query("e33_repo_map", "SELECT split_part(file_path, '/', 2) AS file_path, type, name FROM entities")
def e33(v):
    return Q.repo_map(v("entities").withColumn("file_path", F.split("file_path", "/")[1]))


@query("e35_readiness", "SELECT 'app' || (bundle % 5) AS app_id, count(*) FILTER (status = 'FAIL' AND bundle % 5 < 2) AS fails, CASE WHEN bundle % 5 = 3 THEN 1 ELSE 0 END AS pending, CASE WHEN count(*) FILTER (status = 'FAIL' AND bundle % 5 < 2) > 0 OR bundle % 5 = 3 THEN 'WAIT' ELSE 'READY' END AS verdict FROM runs GROUP BY bundle % 5")
def e35(v):
    c = v("runs").selectExpr("concat('app', bundle % 5) AS app_id", "CASE WHEN bundle % 5 < 2 THEN status ELSE 'PASS' END AS status")
    return Q.readiness(c, v("region").filter("r_regionkey = 3").selectExpr("'app3' AS app_id"))


@query("e38_typed_counts", "SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS type, count(*) AS n FROM events GROUP BY 1")
def e38(v):
    return Q.typed_counts(v("events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n")), ("view", "click"))


@query("a11_replace", "SELECT app_id, id, value FROM (SELECT 'app' || (o_custkey % 5) AS app_id, o_orderkey % 1000 AS id, 'old' || max(o_orderkey) AS value FROM orders WHERE o_custkey % 5 <> 2 GROUP BY ALL) a WHERE app_id NOT IN (SELECT 'app' || (c_custkey % 2) FROM customer) UNION ALL SELECT 'app' || (c_custkey % 2), c_custkey % 50, 'new' || max(c_custkey) FROM customer GROUP BY c_custkey % 2, c_custkey % 50")
def a11b(v):
    from ..sources.sinks import upsert

    old = v("orders").filter("o_custkey % 5 <> 2").selectExpr("concat('app', o_custkey % 5) AS app_id", "o_orderkey % 1000 AS id", "o_orderkey AS ord", "concat('old', o_orderkey) AS value")
    new = v("customer").selectExpr("concat('app', c_custkey % 2) AS app_id", "c_custkey % 50 AS id", "c_custkey AS ord", "concat('new', c_custkey) AS value")
    return upsert(old, new, ["app_id", "id"], "ord", "replace").select("app_id", "id", "value")


@query("a11_upsert", "SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN arg_max('new' || o_orderkey, o_orderkey) ELSE arg_max('old' || o_orderkey, o_orderkey) END AS value FROM orders GROUP BY o_custkey")
def a11(v):
    from ..sources.sinks import upsert

    o = v("orders")
    old = o.selectExpr("o_custkey", "o_orderkey", "concat('old', o_orderkey) AS value")
    new = o.filter("o_custkey % 2 = 0").selectExpr("o_custkey", "o_orderkey", "concat('new', o_orderkey) AS value")
    return upsert(old, new, ["o_custkey"], "o_orderkey").select("o_custkey", "value")


@query("a16_ingest_report", "SELECT user_id AS file, count(*) FILTER (event_type <> 'signup') AS records, count(*) FILTER (event_type = 'error') AS quarantined, CASE WHEN bool_or(event_type = 'signup' AND value > 50) THEN 'failed' ELSE 'succeeded' END AS status FROM events GROUP BY user_id")
def a16(v):
    from ..sources.readers import ingest_report

    r = v("events").selectExpr("user_id AS file", "CASE WHEN event_type = 'signup' THEN 'file' ELSE 'fact' END AS kind", "CASE WHEN event_type = 'error' OR (event_type = 'signup' AND value > 50) THEN 'bad' END AS error")
    return ingest_report(r)


@query("a17_parse_manifest", "SELECT event_type AS category, count(*) AS found, count(*) FILTER (value > 20) AS parsed, count(*) FILTER (NOT value > 20) AS unparseable FROM events GROUP BY 1")
def a17(v):
    from ..sources.readers import parse_manifest

    return parse_manifest(v("events").selectExpr("event_type AS category", "value > 20 AS parsed"))


@query("a18_prefer", "SELECT p_brand, p_type, min(p_size) AS p_size FROM part GROUP BY ALL")
def a18(v):
    from ..sources.readers import prefer

    return prefer(v("part").select("p_brand", "p_type", "p_size"), ["p_brand", "p_type"], "p_size")
