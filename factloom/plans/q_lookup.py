"""Queries for lookups, gates and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import graph as G
from ..functions import scalars as S
from ..operators import lookup as L
from ..operators import resolve as R
from ..sources.staged import stage
from .q_graph import _in
from .registry import query

_ROUTE = "CASE predicate " + " ".join(f"WHEN '{p}' THEN '{t}'" for p, t, _ in vocab.ROUTES) + " END"
_KIND = "CASE predicate " + " ".join(f"WHEN '{p}' THEN '{k}'" for p, _, k in vocab.ROUTES if k) + " END"
KB = f"kb AS MATERIALIZED (SELECT app_id, table_name, name, min(ord) AS ord, arg_min(resolved, ord) AS resolved, arg_min_null(confidence, ord) AS confidence FROM (SELECT app_id, {_ROUTE} AS table_name, ord, substring(object, position(':' in object) + 1) AS name, resolved, confidence FROM facts) x WHERE table_name IS NOT NULL GROUP BY ALL)"


@query("a10_route_facts", f"SELECT ord, {_ROUTE} AS table_name, {_KIND} AS kind FROM facts WHERE {_ROUTE} IS NOT NULL")
def a10(v):
    return L.route_facts(v("facts")).select("ord", "table_name", "kind")


@query("a10_insert_ignore", f"WITH {KB}, both_ AS (SELECT app_id, table_name, name, ord, 0 AS src FROM kb WHERE ord % 3 = 0 UNION ALL SELECT app_id, table_name, name, ord, 1 FROM (SELECT app_id, {_ROUTE} AS table_name, ord, substring(object, position(':' in object) + 1) AS name FROM facts) x WHERE table_name IS NOT NULL) SELECT app_id, table_name, name, arg_min(ord, (src, ord)) AS ord FROM both_ GROUP BY ALL")
def a10b(v):
    from ..sources.sinks import insert_ignore

    columns = ["app_id", "table_name", "name", "ord"]
    routed = L.route_facts(v("facts")).withColumn("name", S.name_of("object")).select(*columns)
    return insert_ignore(L.kb_names(v("facts")).filter("ord % 3 = 0").select(*columns), routed, columns[:3], "ord")


@query("a10_kb_names", f"WITH {KB} SELECT * FROM kb")
def a10c(v):
    return L.kb_names(v("facts"))


_QUERIES = "q AS (SELECT DISTINCT CASE WHEN k % 4 = 3 THEN 'events' ELSE 'core' END AS app_id, CASE k % 4 WHEN 0 THEN 'part.' || k WHEN 1 THEN 'region.AM%' WHEN 2 THEN 'none.' || k ELSE CASE k % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view/' || k ELSE 'VIEW/_' END END AS q FROM (SELECT p_partkey AS k FROM part) x)"


def _queries(v):
    k = F.col("p_partkey")
    q = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('part.', p_partkey) WHEN 1 THEN 'region.AM%' WHEN 2 THEN concat('none.', p_partkey) ELSE CASE p_partkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN concat('view/', p_partkey) ELSE 'VIEW/_' END END")
    return v("part").select(F.when(k % 4 == 3, "events").otherwise("core").alias("app_id"), q.alias("q")).distinct()


@query("c01_c04_resolve_names", f"""WITH {KB}, {_QUERIES}, ex AS (SELECT q.app_id, q, table_name, name, 'exact' AS how, coalesce(resolved, TRUE) AS resolved, coalesce(confidence, 1.0) AS confidence FROM q JOIN kb ON q = name AND q.app_id = kb.app_id),
 bk AS (SELECT DISTINCT q.app_id, q, table_name, q AS name, 'bucket' AS how, TRUE AS resolved, 1.0::DOUBLE AS confidence FROM q JOIN kb ON q.app_id = kb.app_id AND table_name = 'app_s3_paths' AND (starts_with(name, q || '/') OR starts_with(name, 's3://' || q || '/')) AND NOT contains(q, '/') WHERE (q.app_id, q) NOT IN (SELECT (app_id, q) FROM ex)),
 fz AS (SELECT q.app_id, q, table_name, name, 'contains' AS how, coalesce(resolved, TRUE) AS resolved, coalesce(confidence, 0.5) AS confidence FROM q JOIN kb ON q.app_id = kb.app_id AND name ILIKE '%' || q || '%' WHERE (q.app_id, q) NOT IN (SELECT (app_id, q) FROM ex) AND (q.app_id, q) NOT IN (SELECT (app_id, q) FROM bk))
 SELECT app_id, q, table_name, name, how, resolved, confidence FROM (SELECT *, row_number() OVER (PARTITION BY app_id, q ORDER BY table_name, name) AS n FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz UNION ALL SELECT * FROM bk) x) y WHERE n <= 5""")
def c01(v):
    return L.resolve_names(_queries(v), L.kb_names(v("facts")))


@query("c05_open_feedback", "SELECT id, unit, artifact FROM feedback WHERE status = 'open' AND app_id = 'app1' AND artifact = 'test'")
def c05(v):
    return L.open_feedback(v("feedback"), "app1", artifact="test").select("id", "unit", "artifact")


@query("c06_validate_feedback", "SELECT id, list_sort(list_filter([CASE WHEN unit IS NULL THEN 'unit' END, CASE WHEN artifact NOT IN ('spec', 'test') THEN 'artifact' END, CASE WHEN action IN ('reject', 'comment') AND trim(comment) = '' THEN 'comment' END], lambda x: x IS NOT NULL)) AS errors FROM feedback")
def c06(v):
    return L.validate_feedback(v("feedback")).select("id", "errors")


@query("c07_validate_labels", f"WITH lab AS (SELECT id, CASE WHEN id % 31 = 0 THEN 'odd' ELSE stage END AS stage FROM profiles WHERE id % 10 <> 0 UNION ALL SELECT id, stage FROM profiles WHERE id % 41 = 0) SELECT DISTINCT * FROM (SELECT id, 'enum' AS problem FROM lab WHERE stage NOT IN {_in(vocab.STAGES)} UNION ALL SELECT id, 'duplicate' FROM lab GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'missing' FROM profiles WHERE id % 7 <> 0 AND id NOT IN (SELECT id FROM lab) UNION ALL SELECT id, 'unexpected' FROM lab WHERE id NOT IN (SELECT id FROM profiles WHERE id % 7 <> 0)) x")
def c07(v):
    p = v("profiles")
    lab = p.filter("id % 10 <> 0").select("id", F.when(F.col("id") % 31 == 0, "odd").otherwise(F.col("stage")).alias("stage"), "intent").unionByName(p.filter("id % 41 = 0").select("id", "stage", "intent"))
    return L.validate_labels(lab, p.filter("id % 7 <> 0"))


@query("c08_facts_of_file", "SELECT ord, subject, predicate, object FROM facts WHERE file_path = 'core/functi/f7.py' AND NOT resolved")
def c08(v):
    return L.facts_of_file(v("facts"), "core/functi/f7.py", True).select("ord", "subject", "predicate", "object")


@query("c09_human_sections", "SELECT 'u' || p_partkey AS unit, 'overview' AS section FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'u' || p_partkey, 'stories' FROM part WHERE p_size % 3 = 0")
def c09(v):
    m = F.create_map(F.lit("overview"), F.when(F.col("p_size") % 2 == 0, "human").otherwise("agent"), F.lit("stories"), F.when(F.col("p_size") % 3 == 0, "human").otherwise("agent"))
    return L.human_sections(v("part").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("unit"), m.alias("section_provenance")))


@query("c10_requirement_lookup", "WITH r AS (SELECT app_id, unit, max(id) AS id FROM feedback WHERE unit IS NOT NULL AND event = 1 GROUP BY ALL), u AS (SELECT DISTINCT 'app' || (user_id % 6) AS app_id, 'unit' || (user_id % 10) AS unit FROM events) SELECT u.app_id, u.unit, r.id, r.id IS NOT NULL AS found FROM u LEFT JOIN r USING (app_id, unit)".replace(" AND event = 1", " AND artifact = 'spec'"))
def c10(v):
    e = v("events").select(F.expr("concat('app', user_id % 6) AS app_id"), F.expr("concat('unit', user_id % 10) AS unit")).distinct()
    return L.requirement_lookup(e, v("feedback").filter("unit IS NOT NULL AND artifact = 'spec'").select("app_id", "unit", "id")).select("app_id", "unit", "id", "found")


@query("c11_human_facts", "SELECT ord, subject FROM facts WHERE extraction_method = 'human' AND subject = 'Function:nation.NATION_17'")
def c11(v):
    return L.facts_of(v("facts"), "Function:nation.NATION_17", human=True).select("ord", "subject")


@query("d09_spec_inventory_join", "SELECT f.app_id, count(*) AS matched FROM feedback f JOIN (SELECT 'app' || (user_id % 4) AS app_id, 'unit' || (user_id % 10) AS symbol FROM events WHERE event_type = 'view') e ON f.app_id = e.app_id AND f.unit = e.symbol WHERE f.status = 'open' AND f.artifact = 'spec' GROUP BY f.app_id")
def d09(v):
    return L.spec_inventory_join(v("feedback").filter("status = 'open' AND artifact = 'spec'"), v("events").filter("event_type = 'view'").selectExpr("concat('app', user_id % 4) AS app_id", "concat('unit', user_id % 10) AS symbol"))


@query("d10_orphans", "SELECT id, app_id FROM feedback WHERE app_id NOT IN ('app0', 'app2')")
def d10(v):
    apps = v("nation").filter("n_nationkey IN (0, 2)").selectExpr("concat('app', n_nationkey) AS app_id")
    return L.orphans(v("feedback").select("id", "app_id"), apps)


@query("d11_grounding_gate", f"WITH {KB}, c AS (SELECT p_partkey AS entry, 'core' AS app_id, CASE WHEN p_partkey % 3 = 0 THEN 'ghost.' ELSE 'part.' END || p_partkey AS name FROM part), g AS (SELECT app_id, name, bool_or(coalesce(resolved, TRUE)) AS ok FROM kb GROUP BY ALL) SELECT c.entry, c.app_id, c.name, CASE WHEN ok THEN 'confirmed' WHEN ok IS NOT NULL THEN 'unresolved' ELSE 'unknown' END AS verdict FROM c LEFT JOIN g USING (app_id, name)")
def d11(v):
    c = v("part").selectExpr("p_partkey AS entry", "'core' AS app_id", "concat(CASE WHEN p_partkey % 3 = 0 THEN 'ghost.' ELSE 'part.' END, p_partkey) AS name")
    return L.grounding_gate(c, L.kb_names(v("facts")))


@query("d12_coverage_gap", "SELECT type, name FROM entities WHERE type <> 'Method' AND name NOT LIKE 'ord.%7' AND name NOT LIKE 'ord.%1' AND NOT (type = 'Function' AND name LIKE 'supp.%')")
def d12(v):
    e = stage(v("entities").select("type", "name"), "entities")  # read five times
    named = e.filter("name LIKE 'ord.%7'").select("name").union(e.filter("name LIKE 'ord.%1'").select(F.concat("type", F.lit(":"), "name"))).union(e.limit(1).select(F.lit("Journey:x")))
    chains = e.filter("name LIKE 'supp.%'").select(F.lit("Journey:x").alias("chain"), F.concat("type", F.lit(":"), "name").alias("member"))
    return L.coverage_gap(e, named, ("Method",), chains)


@query("d13_feedback_gate", "SELECT id FROM feedback WHERE action IN ('reject', 'comment') AND id % 4 <> 0")
def d13(v):
    f = v("feedback")
    return L.feedback_gate(f, f.filter("id % 4 = 0").groupBy("unit").agg(F.collect_list("id").alias("feedback_ids")))


@query("d14_story_gate", f"WITH d AS (SELECT 'u' || (p_partkey % 40) AS unit, CASE WHEN p_partkey % 40 < 20 THEN 'Table:part.' ELSE 'Table:none.' END || p_partkey AS name FROM part) SELECT DISTINCT unit FROM d WHERE unit NOT IN (SELECT unit FROM d WHERE name IN (SELECT object FROM facts WHERE predicate IN {_in(vocab.OBSERVABLE)}))")
def d14(v):
    d = v("part").selectExpr("concat('u', p_partkey % 40) AS unit", "concat(CASE WHEN p_partkey % 40 < 20 THEN 'Table:part.' ELSE 'Table:none.' END, p_partkey) AS name")
    return L.story_gate(d, v("facts"))


@query("e02_inventory", "SELECT type, count(DISTINCT name) AS n, list_sort(list(DISTINCT name))[1:100] AS names FROM entities GROUP BY type")
def e02(v):
    return L.inventory(v("entities"))


_CHAINS = "chain AS (SELECT 'Journey:' || o_custkey AS subject, 'HAS_MEMBER' AS predicate, 'Step:ord.' || o_orderkey AS object, o_orderkey AS line FROM orders UNION ALL SELECT DISTINCT 'Journey:' || o_custkey, 'STARTS_AT', 'Method:cust.' || o_custkey, 0 FROM orders)"


def _chains(v):
    o = v("orders")
    return o.selectExpr("concat('Journey:', o_custkey) AS subject", "'HAS_MEMBER' AS predicate", "concat('Step:ord.', o_orderkey) AS object", "o_orderkey AS line").unionByName(o.selectExpr("concat('Journey:', o_custkey) AS subject", "'STARTS_AT' AS predicate", "concat('Method:cust.', o_custkey) AS object", "0L AS line").distinct())


@query("e25_chain_members", f"WITH {_CHAINS} SELECT subject AS chain, list_sort(list(DISTINCT object)) AS members FROM chain GROUP BY subject")
def e25(v):
    return L.chain_members(_chains(v))


@query("e26_journeys_from_facts", f"WITH {_CHAINS} SELECT subject AS journey, min(object) FILTER (predicate = 'STARTS_AT') AS start, list(object ORDER BY line) FILTER (predicate = 'HAS_MEMBER') AS members FROM chain GROUP BY subject")
def e26(v):
    return G.journeys_from_facts(_chains(v))


@query("e26_verdict_tallies", f"WITH {_CHAINS}, j AS (SELECT DISTINCT subject AS journey FROM chain) SELECT CASE length(journey) % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, count(*) AS n FROM j GROUP BY 1")
def e26b(v):
    j = _chains(v).select(F.col("subject").alias("journey")).distinct()
    status = F.expr("CASE length(journey) % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'deferred' END")
    said = j.filter("length(journey) % 4 <> 3").select("journey", F.lit(2).alias("ord"), status.alias("status"))
    return G.verdict_tallies(j, said.unionByName(said.select("journey", F.lit(1).alias("ord"), F.lit("rejected").alias("status"))))


BOUND = "bound AS (SELECT token, arg_min(value, layer) AS value FROM bindings GROUP BY token)"
TEXT = f"{BOUND}, s AS (SELECT t.*, CASE WHEN p.value IS NULL THEN u ELSE replace(u, '${{' || p.token || '}}', p.value) END AS text FROM (SELECT t.*, CASE WHEN b.value IS NULL THEN t.object ELSE replace(t.object, '${{' || b.token || '}}', b.value) END AS u, regexp_extract_all(t.object, '\\$\\{{([^}}]+)\\}}', 1) AS toks FROM templated t LEFT JOIN bound b ON b.token = regexp_extract(t.object, '\\$\\{{([^}}]+)\\}}', 1)) t LEFT JOIN bound p ON p.token = t.toks[2])"


@query("d01_bind", f"WITH {BOUND} SELECT token, value FROM bound")
def d01(v):
    return R.bind(v("bindings"))


@query("b05_substitute", f"WITH {TEXT} SELECT ord, text, NOT contains(text, '${{') AS fully_resolved FROM s")
def b05(v):
    return R.substitute(v("templated"), "object", v("bindings")).select("ord", "text", "fully_resolved")


@query("b06_apply_resolution", f"WITH {TEXT} SELECT ord, CASE WHEN NOT contains(text, '${{') AND NOT symbolic THEN TRUE ELSE resolved END AS resolved, CASE WHEN NOT contains(text, '${{') AND NOT symbolic THEN 1.0 ELSE confidence END AS confidence FROM s")
def b06(v):
    return R.apply_resolution(R.substitute(v("templated"), "object", v("bindings"))).select("ord", "resolved", "confidence")


@query("d08_rename", "SELECT ord, CASE WHEN subject LIKE 'Function:nation.%' THEN subject || '_v2' ELSE subject END AS subject, CASE WHEN object LIKE 'Function:nation.%' THEN object || '_v2' ELSE object END AS object FROM facts")
def d08(v):
    m = v("nation").selectExpr("concat('Function:nation.', n_name) AS old", "concat('Function:nation.', n_name, '_v2') AS new")
    return R.rename(v("facts"), m).select("ord", "subject", "object")


@query("d08_stale_renames", "SELECT 'Function:gone.' || n_name AS old, n_name AS new FROM nation")
def d08b(v):
    n = v("nation")
    m = n.selectExpr("concat('Function:nation.', n_name) AS old", "n_name AS new").union(n.selectExpr("concat('Function:gone.', n_name)", "n_name"))
    return R.stale_renames(v("facts"), m)


@query("e24_token_usages", r"WITH u AS (SELECT ord, subject, unnest(list_distinct(regexp_extract_all(object, '\$\{([^}]+)\}', 1))) AS token FROM templated) SELECT token, count(*) AS uses, list(subject ORDER BY ord)[1:3] AS sample FROM u WHERE token NOT IN (SELECT token FROM bindings) GROUP BY token")
def e24(v):
    return R.token_usages(v("templated"), v("bindings"))


@query("g02_stale_answers", "SELECT DISTINCT n_name AS token FROM nation")
def g02(v):
    return R.stale_answers(v("bindings").select("token").union(v("nation").select("n_name")), v("templated"))


@query("g03_contradictions", "SELECT DISTINCT token FROM bindings WHERE token < 'G'")
def g03(v):
    return R.contradictions(v("bindings"), v("bindings").filter("token < 'G'"))
