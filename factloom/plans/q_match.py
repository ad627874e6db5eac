"""Queries for matching, scoring, gates, sets and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import gates as T
from ..operators import match as M
from ..operators.graph import latest
from ..operators.text import scan_headers
from .q_scalars import _INTENT, _labels, _norm, _stage
from .registry import query

_COMPAT = " OR ".join(f"(a.stage = '{x}' AND b.stage = '{y}')" for x, y in vocab.COMPATIBLE)
_JAC = "CASE WHEN len(a.{0}) + len(b.{0}) = 0 THEN 1.0 ELSE len(list_intersect(a.{0}, b.{0})) / len(list_distinct(list_concat(a.{0}, b.{0}))) END"
_BASE = f"0.30 * CASE WHEN a.stage = b.stage THEN 1.0 WHEN a.stage = 'general' OR {_COMPAT} THEN 0.7 ELSE 0.0 END + 0.45 * {_JAC.format('actions')} + 0.25 * {_JAC.format('outcomes')}"
PAIRS = f"pairs AS (SELECT * FROM (SELECT a.app_id, a.stage, a.intent, a.actions, a.outcomes, b.stage AS stage2, b.intent AS intent2, b.actions AS actions2, b.outcomes AS outcomes2, CASE WHEN a.intent <> b.intent AND a.intent <> 'neutral' AND b.intent <> 'neutral' THEN 0.0 WHEN a.intent = b.intent AND a.intent <> 'neutral' THEN least(1.0, {_BASE} + 0.05) ELSE {_BASE} END::DOUBLE AS score FROM (SELECT DISTINCT app_id, stage, intent, actions, outcomes FROM profiles WHERE side = 'ref') a JOIN (SELECT DISTINCT app_id, stage, intent, actions, outcomes FROM profiles WHERE side = 'cand') b ON a.app_id = b.app_id) x WHERE score > 0)"


def _sides(v):
    p = v("profiles")
    return p.filter("side = 'ref'"), p.filter("side = 'cand'")


@query("d15_pair_scores", f"WITH {PAIRS} SELECT app_id, stage, intent, actions, stage2, intent2, round(score, 6) AS score, count(*) AS n FROM pairs GROUP BY ALL")
def d15(v):
    return M.pair_scores(*_sides(v)).groupBy("app_id", "stage", "intent", "actions", "stage2", "intent2", F.round("score", 6).alias("score")).agg(F.count("*").alias("n"))


_STRICT = f"CASE WHEN a.intent <> b.intent OR a.stage <> b.stage OR (len(list_intersect(a.actions, b.actions)) = 0 AND len(a.actions) + len(b.actions) > 0) THEN 0.0 ELSE {_BASE} END::DOUBLE"


@query("d15_strict_scores", f"SELECT app_id, stage, intent, actions, actions2, round(score, 6) AS score, count(*) AS n FROM (SELECT a.app_id, a.stage, a.intent, a.actions, b.actions AS actions2, {_STRICT} AS score FROM (SELECT DISTINCT app_id, stage, intent, actions, outcomes FROM profiles WHERE side = 'ref') a JOIN (SELECT DISTINCT app_id, stage, intent, actions, outcomes FROM profiles WHERE side = 'cand') b ON a.app_id = b.app_id) x WHERE score > 0 GROUP BY ALL")
def d15b(v):
    return M.pair_scores(*_sides(v), strict=True).groupBy("app_id", "stage", "intent", "actions", "actions2", F.round("score", 6).alias("score")).agg(F.count("*").alias("n"))


# each step takes the best pair behind the last one whose ends are both free
GREEDY = f"{PAIRS}, ranked AS MATERIALIZED (SELECT r.app_id, r.id AS ref_id, c.id AS cand_id, round(p.score, 6) AS score, row_number() OVER (PARTITION BY r.app_id ORDER BY p.score DESC, r.id, c.id) AS rk FROM pairs p JOIN profiles r ON r.side = 'ref' AND r.app_id = p.app_id AND r.stage = p.stage AND r.intent = p.intent AND r.actions = p.actions AND r.outcomes = p.outcomes JOIN profiles c ON c.side = 'cand' AND c.app_id = p.app_id AND c.stage = p.stage2 AND c.intent = p.intent2 AND c.actions = p.actions2 AND c.outcomes = p.outcomes2 WHERE p.score >= 0.45), steps AS (SELECT app_id, 0::BIGINT AS rk, []::BIGINT[] AS refs, []::BIGINT[] AS cands FROM (SELECT DISTINCT app_id FROM ranked) a UNION ALL SELECT s.app_id, n.rk, list_append(s.refs, n.ref_id), list_append(s.cands, n.cand_id) FROM steps s JOIN LATERAL (SELECT min(q.rk) AS rk, arg_min(q.ref_id, q.rk) AS ref_id, arg_min(q.cand_id, q.rk) AS cand_id FROM ranked q WHERE q.app_id = s.app_id AND q.rk > s.rk AND NOT list_contains(s.refs, q.ref_id) AND NOT list_contains(s.cands, q.cand_id)) n ON n.rk IS NOT NULL), matched AS (SELECT q.app_id, q.ref_id, q.cand_id, q.score FROM steps s JOIN ranked q USING (app_id, rk))"


@query("d16_greedy_match", f"WITH RECURSIVE {GREEDY} SELECT app_id, ref_id, cand_id, score FROM matched")
def d16(v):
    return M.greedy_match(*_sides(v)).withColumn("score", F.round("score", 6))


@query("d16_unmatched_best", f"WITH RECURSIVE {GREEDY} SELECT p.app_id, p.id, round(coalesce((SELECT max(score) FROM pairs q WHERE q.app_id = p.app_id AND q.stage = p.stage AND q.intent = p.intent AND q.actions = p.actions AND q.outcomes = p.outcomes), 0.0), 6) AS best FROM profiles p WHERE side = 'ref' AND id NOT IN (SELECT ref_id FROM matched)")
def d16b(v):
    r, c = _sides(v)
    return M.unmatched(r, c, M.greedy_match(r, c)).select("app_id", "id", F.round("best", 6).alias("best"))


@query("d17_triangulate", "WITH m AS (SELECT o_orderpriority || (o_custkey % 50) AS generated, arg_max('m' || o_orderkey, o_orderkey) AS manual FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), r AS (SELECT o_orderpriority || (o_custkey % 50) AS generated, arg_max('r' || o_orderkey, o_orderkey) AS requirement FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT * FROM m JOIN r USING (generated)")
def d17(v):
    o = v("orders").selectExpr("concat(o_orderpriority, o_custkey % 50) AS generated", "o_orderkey AS ord", "o_orderstatus")
    return M.triangulate(o.filter("o_orderstatus = 'F'").selectExpr("generated", "ord", "concat('m', ord) AS manual"), o.filter("o_orderstatus <> 'F'").selectExpr("generated", "ord", "concat('r', ord) AS requirement"))


@query("d18_near_unit", "SELECT 'F' || r_regionkey || '.FEATURE' AS unit, name FROM profiles JOIN region ON contains(lower(feature_file), 'f' || r_regionkey || '.feature') OR contains(lower(name), 'f' || r_regionkey || '.feature')")
def d18(v):
    return M.near_unit(v("region").selectExpr("concat('F', r_regionkey, '.FEATURE') AS unit"), v("profiles"))


@query("d26_match_requirements", f"WITH RECURSIVE {GREEDY} SELECT m.app_id, m.ref_id AS item, m.cand_id AS generated, m.score, r.feature_file AS unit, r.intent = 'negative' AS negative FROM matched m JOIN profiles r ON r.side = 'ref' AND r.id = m.ref_id")
def d26(v):
    r, c = _sides(v)
    return M.match_requirements(r.withColumn("unit", F.col("feature_file")), c).withColumn("score", F.round("score", 6))


def _credits(v):
    c = v("customer")
    return c.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS manual", "c_custkey + 1 AS generated"), c.filter("c_custkey % 3 = 0").selectExpr("c_custkey AS manual"), c.filter("c_custkey % 5 <> 1").selectExpr("c_custkey AS generated")


@query("d27_apply_credits", "SELECT c_custkey AS manual, c_custkey + 1 AS generated FROM customer WHERE c_custkey % 6 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 1)")
def d27(v):
    return M.apply_credits(*_credits(v))[0]


@query("d27_still_missing", "SELECT c_custkey AS manual FROM customer WHERE c_custkey % 3 = 0 AND NOT (c_custkey % 2 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 1))")
def d27b(v):
    return M.apply_credits(*_credits(v))[1]


_ACTS = _labels("t", vocab.ACTION_PHRASES)
PROFILE = f"""st AS (SELECT *, {_norm('text')} AS t FROM scenarios), sa AS (SELECT *, CASE WHEN keyword IN ('When', 'Then') THEN {_ACTS} ELSE [] END AS a FROM st), g AS (SELECT feature_file, feature_name, name, list_sort(list_distinct(flatten(list(a)))) AS actions, string_agg(text, ' ' ORDER BY pos) AS texts FROM sa GROUP BY ALL), n AS (SELECT *, {_norm("name || ' ' || texts")} AS t, {_norm("feature_file || ' ' || feature_name || ' ' || name || ' ' || texts")} AS c FROM g)"""


@query("b16_profile_scenarios", f"WITH {PROFILE} SELECT feature_file, name, coalesce({_stage('c')}, 'general') AS stage, {_INTENT} AS intent, actions FROM n")
def b16(v):
    return M.profile_scenarios(v("scenarios")).select("feature_file", "name", "stage", "intent", "actions")


@query("b30_summarize_scenarios", "SELECT feature_file || '::' || name AS id, coalesce(string_agg(keyword || ' ' || text, chr(10) ORDER BY pos) FILTER (keyword = 'Given'), '') AS given, coalesce(string_agg(keyword || ' ' || text, chr(10) ORDER BY pos) FILTER (keyword <> 'Given'), '') AS when_then, string_agg(keyword || ' ' || text, chr(10) ORDER BY pos) AS all_lines FROM scenarios GROUP BY feature_file, name")
def b30(v):
    return M.summarize_scenarios(v("scenarios"))


@query("f01_first_wins", "SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def f01(v):
    return latest(v("orders"), ["o_custkey"], ["o_orderpriority", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("f02_approved_examples", "SELECT id, rank FROM (SELECT id, app_id, row_number() OVER (PARTITION BY app_id ORDER BY (unit = 'unit3') DESC NULLS LAST, created_at DESC, id DESC) AS rank FROM feedback WHERE action = 'approve') x WHERE rank <= 2")
def f02(v):
    return M.approved_examples(v("feedback").filter("action = 'approve'"), "unit3").select("id", "rank")


@query("f07_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def f07(v):
    return M.top_k(v("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 5)


@query("f08_batch", "WITH RECURSIVE items AS MATERIALIZED (SELECT doc_id, pos, length(line) AS size FROM doc_lines), b AS (SELECT doc_id, pos, 1 AS n, size AS chars, 0 AS batch FROM items WHERE pos = 0 UNION ALL SELECT i.doc_id, i.pos, CASE WHEN b.n >= 25 OR b.chars + i.size > 12000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 25 OR b.chars + i.size > 12000 THEN i.size ELSE b.chars + i.size END, b.batch + CASE WHEN b.n >= 25 OR b.chars + i.size > 12000 THEN 1 ELSE 0 END FROM b JOIN items i ON i.doc_id = b.doc_id AND i.pos = b.pos + 1) SELECT doc_id, pos, batch FROM b")
def f08(v):
    return M.batch(v("doc_lines").withColumn("size", F.length("line")), 25, 12_000)


_CHECKED = "s AS (SELECT feature_file, conv_id, CASE WHEN conv_id % 7 = 0 THEN ' ' ELSE name END AS name, pos, keyword, text, CASE keyword WHEN 'Given' THEN 0 WHEN 'When' THEN 1 ELSE 2 END AS r FROM scenarios), p AS (SELECT feature_file, conv_id, name, bool_or(keyword = 'Given') AS g, bool_or(keyword = 'When') AS w, bool_or(keyword = 'Then') AS t, count(*) FILTER (trim(text) = '') AS e, bool_or(r < last) AS late FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY pos) AS last FROM s) y GROUP BY ALL)"


def _steps(v):
    return v("scenarios").withColumn("name", F.expr("CASE WHEN conv_id % 7 = 0 THEN ' ' ELSE name END"))


@query("e13_compliance", f"WITH {_CHECKED} SELECT feature_file, count(*) AS scenarios, count(*) - count(DISTINCT name) FILTER (NOT (g AND w AND t) OR e > 0 OR trim(name) = '') AS ok, 100.0 * (count(*) - count(DISTINCT name) FILTER (NOT (g AND w AND t) OR e > 0 OR trim(name) = '')) / count(*) AS pct FROM p GROUP BY feature_file")
def e13(v):
    return T.compliance(_steps(v), "conv_id")


@query("e13_findings", f"WITH {_CHECKED} SELECT feature_file, conv_id, name, 'scenario-name-required' AS rule, 'ERROR' AS severity FROM p WHERE trim(name) = '' UNION ALL SELECT feature_file, conv_id, name, 'given-required', 'ERROR' FROM p WHERE NOT g UNION ALL SELECT feature_file, conv_id, name, 'when-required', 'ERROR' FROM p WHERE NOT w UNION ALL SELECT feature_file, conv_id, name, 'then-required', 'ERROR' FROM p WHERE NOT t UNION ALL SELECT feature_file, conv_id, name, 'keyword-order', 'WARNING' FROM p WHERE late UNION ALL SELECT feature_file, conv_id, name, 'empty-step', 'ERROR' FROM p, range(e)")
def e13b(v):
    return T.compliance_findings(_steps(v), "conv_id")


@query("e14_action_coverage", f"WITH {PAIRS}, a AS (SELECT DISTINCT app_id, unnest(actions) AS a FROM profiles WHERE side = 'ref'), h AS (SELECT DISTINCT app_id, unnest(list_intersect(actions, actions2)) AS a FROM pairs WHERE score >= 0.9) SELECT app_id, 100.0 * count(*) FILTER ((app_id, a) IN (SELECT (app_id, a) FROM h)) / count(*) AS action_coverage FROM a GROUP BY app_id")
def e14(v):
    r, c = _sides(v)
    return T.action_coverage(r, M.pair_scores(r, c).filter("score >= 0.9"))


_HIT = "(id % 3 = 0)"


@query("e15_path_coverage", f"SELECT app_id, CASE WHEN count(*) FILTER (intent = 'positive') > 0 THEN 100.0 * count(*) FILTER (intent = 'positive' AND {_HIT}) / count(*) FILTER (intent = 'positive') ELSE 100.0 END AS positive, CASE WHEN count(*) FILTER (intent = 'negative') > 0 THEN 100.0 * count(*) FILTER (intent = 'negative' AND {_HIT}) / count(*) FILTER (intent = 'negative') ELSE 100.0 END AS negative FROM profiles WHERE side = 'ref' GROUP BY app_id")
def e15(v):
    r, _ = _sides(v)
    return T.path_coverage(r, r.filter(_HIT))


@query("e16_stage_coverage", f"SELECT app_id, 100.0 * count(*) FILTER (h) / count(*) AS pct FROM (SELECT app_id, stage, bool_or({_HIT}) AS h FROM profiles WHERE side = 'ref' GROUP BY ALL) x GROUP BY app_id")
def e16(v):
    r, _ = _sides(v)
    return T.coverage_of(r, r.filter(_HIT), "stage")


@query("e17_feature_completeness", f"SELECT app_id, 100.0 * count(*) FILTER (h) / count(*) AS pct FROM (SELECT app_id, feature_file, bool_or({_HIT}) AS h FROM profiles WHERE side = 'ref' GROUP BY ALL) x GROUP BY app_id")
def e17(v):
    r, _ = _sides(v)
    return T.coverage_of(r, r.filter(_HIT), "feature_file")


@query("g06_uncovered_files", f"SELECT app_id, feature_file FROM profiles WHERE side = 'ref' GROUP BY ALL HAVING NOT bool_or({_HIT})")
def g06(v):
    r, _ = _sides(v)
    return T.uncovered(r, r.filter(_HIT), "feature_file")


def _counts(v):
    return v("profiles").groupBy("app_id").agg(F.count("*").alias("n_gen"), F.count_if(_hit()).alias("matched"), F.count_if(F.col("id") % 9 == 0).alias("redundant_matched"), F.count_if(F.col("id") % 2 == 0).alias("covered"))


def _hit():
    return F.col("id") % 3 == 0


_PE = "SELECT app_id, count(*) AS n_gen, count(*) FILTER (id % 3 = 0) AS matched, count(*) FILTER (id % 9 = 0) AS redundant_matched, count(*) FILTER (id % 2 = 0) AS covered, 100.0 * greatest(0, count(*) FILTER (id % 3 = 0) - count(*) FILTER (id % 9 = 0)) / count(*) AS precision, least(100.0, 100.0 * count(*) FILTER (id % 2 = 0) / count(*)) AS efficiency FROM profiles GROUP BY app_id"


@query("e18_precision_efficiency", _PE)
def e18(v):
    return T.precision_efficiency(_counts(v))


@query("e19_overall", f"SELECT app_id, round(0.35 * precision + 0.125 * efficiency + 0.075 * precision + 0.10 * efficiency + 0.05 * 100.0 + 0.05 * 0.0 + 0.125 * efficiency + 0.125 * precision, 6) AS overall FROM ({_PE}) x")
def e19(v):
    m = T.precision_efficiency(_counts(v))
    m = m.select("app_id", F.col("precision").alias("manual_recall"), F.col("efficiency").alias("manual_action"), F.col("precision").alias("manual_positive"), F.col("efficiency").alias("manual_negative"), F.lit(100.0).alias("manual_stage"), F.lit(0.0).alias("manual_feature"), F.col("efficiency").alias("coverage_efficiency"), F.col("precision").alias("suite_precision"))
    return T.overall(m).select("app_id", F.round("overall", 6).alias("overall"))


@query("e19_overall_with_requirements", f"SELECT app_id, round(0.28 * precision + 0.10 * efficiency + 0.06 * precision + 0.08 * efficiency + 0.04 * 100.0 + 0.04 * 0.0 + 0.10 * efficiency + 0.10 * precision + 0.12 * efficiency + 0.08 * precision, 6) AS overall FROM ({_PE}) x")
def e19b(v):
    m = T.precision_efficiency(_counts(v))
    p, e = F.col("precision"), F.col("efficiency")
    m = m.select("app_id", *[c.alias(k) for k, c in {"manual_recall": p, "manual_action": e, "manual_positive": p, "manual_negative": e, "manual_stage": F.lit(100.0), "manual_feature": F.lit(0.0), "coverage_efficiency": e, "suite_precision": p, "requirement_recall": e, "triangulation": p}.items()])
    return T.overall(m, vocab.WEIGHTS_FULL).select("app_id", F.round("overall", 6).alias("overall"))


@query("e15_requirement_paths", f"SELECT app_id, CASE WHEN count(*) FILTER (NOT neg) > 0 THEN 100.0 * count(*) FILTER (NOT neg AND {_HIT}) / count(*) FILTER (NOT neg) ELSE 100.0 END AS positive, CASE WHEN count(*) FILTER (neg) > 0 THEN 100.0 * count(*) FILTER (neg AND {_HIT}) / count(*) FILTER (neg) ELSE 100.0 END AS negative FROM (SELECT *, intent = 'negative' AS neg FROM profiles WHERE side = 'ref') x GROUP BY app_id")
def e15b(v):
    r, _ = _sides(v)
    return T.requirement_paths(r.withColumn("is_negative", F.col("intent") == "negative"), r.filter(_HIT))


@query("e20_unit_traceability", "WITH i AS (SELECT c_mktsegment AS unit, count(DISTINCT c_custkey) AS criteria, count(DISTINCT c_custkey) FILTER (o_orderkey IS NOT NULL) AS covered, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderpriority IS NOT NULL)) AS generated FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), m AS (SELECT c_mktsegment AS unit, count(*) AS nearby, count(*) FILTER (c_nationkey % 2 = 0) AS nearby_covered FROM customer WHERE c_custkey % 4 = 0 AND c_mktsegment <> 'BUILDING' GROUP BY 1) SELECT unit, criteria, covered, generated, 100.0 * covered / criteria AS pct, coalesce(nearby, 0) AS nearby, coalesce(nearby_covered, 0) AS nearby_covered, CASE WHEN nearby > 0 THEN 100.0 * nearby_covered / nearby ELSE 100.0 END AS nearby_pct FROM i LEFT JOIN m USING (unit)")
def e20(v):
    near = v("customer").filter("c_custkey % 4 = 0 AND c_mktsegment <> 'BUILDING'").selectExpr("c_mktsegment AS unit", "c_custkey AS manual", "c_nationkey % 2 = 0 AS covered")
    return T.unit_traceability(v("customer").selectExpr("c_custkey AS id", "c_mktsegment AS unit"), v("orders").selectExpr("o_custkey AS id", "o_orderpriority AS generated"), near)


_DOCS = "d AS (SELECT doc_id || CASE WHEN doc_id % 2 = 0 THEN '.MD' ELSE '.json' END AS file, doc_id, text FROM documents), n AS (SELECT doc_id, pos, line FROM doc_lines WHERE doc_id % 3 <> 0 OR pos % 2 = 0)"


def _docs(v):
    d = v("documents").selectExpr("concat(doc_id, CASE WHEN doc_id % 2 = 0 THEN '.MD' ELSE '.json' END) AS file", "text")
    n = v("doc_lines").filter("doc_id % 3 <> 0 OR pos % 2 = 0").selectExpr("concat(doc_id, CASE WHEN doc_id % 2 = 0 THEN '.MD' ELSE '.json' END) AS file", "pos AS at", "line AS body")
    steps = v("scenarios").selectExpr("CASE WHEN conv_id % 3 = 0 THEN 'manual' ELSE 'generated' END AS suite", "feature_file", "conv_id AS at", "text")
    return T.integrity(steps, steps.groupBy("suite", "feature_file", "at").count().filter("count > 2").select("suite"), d, n, v("nation"), {"requirement_items": 3, "requirement_sections": -1})


@query("e21_integrity", f"WITH {_DOCS}, s AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'manual' ELSE 'generated' END AS suite, feature_file, conv_id, count(*) AS n FROM scenarios GROUP BY ALL), q AS (SELECT count(*) AS files, count(*) FILTER (file LIKE '%.MD') AS md, sum(strlen(text))::BIGINT AS bytes, (SELECT count(*) FROM n) AS sections FROM d) SELECT suite, count(DISTINCT feature_file) AS files, count(*) AS scenarios, sum(n)::BIGINT AS steps, count(*) FILTER (n > 2) AS outlines, any_value(q.files) AS requirement_files, any_value(md) AS requirement_md_files, any_value(bytes) AS requirement_bytes, any_value(sections) AS requirement_sections, 25::BIGINT AS requirement_items, ['requirement_items: 25 parsed, 3 reported', 'requirement_sections: ' || any_value(sections) || ' parsed, -1 reported'] AS notes FROM s, q GROUP BY suite")
def e21(v):
    return _docs(v)[0]


@query("e21_raw_texts", f"WITH {_DOCS}, j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS joined FROM n GROUP BY doc_id), x AS (SELECT file, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS raw, trim(joined, ' ' || chr(9) || chr(10) || chr(13)) AS said, joined FROM d JOIN j USING (doc_id)) SELECT file || ': raw_text preserved alongside sections.' AS note FROM x WHERE raw <> '' AND said <> '' AND NOT contains(joined, raw)")
def e21b(v):
    return _docs(v)[1]


@query("e27_gate_cascade", "SELECT bundle, count(*) FILTER (status = 'FAIL') = 0 AS delivered, arg_min(gate, CASE gate WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 WHEN 3 THEN 4 ELSE 5 END) FILTER (status = 'FAIL') AS failed_gate, count(*) FILTER (status = 'PASS') AS passed FROM runs GROUP BY bundle")
def e27(v):
    return T.gate_cascade(v("runs"))


@query("e27_gate_evidence", "SELECT bundle, key, sum(n)::BIGINT AS n FROM (SELECT bundle, 'lines' AS key, gate * 2 AS n FROM runs UNION ALL SELECT bundle, 'mutants', gate FROM runs WHERE status = 'PASS') x GROUP BY ALL")
def e27b(v):
    data = "CASE WHEN status = 'PASS' THEN map('lines', gate * 2, 'mutants', gate) ELSE map('lines', gate * 2) END AS data"
    return T.gate_evidence(v("runs").selectExpr("bundle", data))


@query("e28_stability", "SELECT bundle, count(DISTINCT status) = 1 AS stable, count(*) AS runs FROM runs GROUP BY bundle")
def e28(v):
    return T.stability(v("runs"))


@query("e29_kill_count", "SELECT bundle, count(*) FILTER (gate <> 1) AS mutants, count(*) FILTER (gate <> 1 AND status = 'FAIL') AS caught, CASE WHEN bool_or(gate = 1 AND status = 'FAIL') THEN 'FAIL' WHEN count(*) FILTER (gate <> 1) = 0 THEN 'SKIP' WHEN count(*) FILTER (gate <> 1 AND status = 'FAIL') > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM runs GROUP BY bundle")
def e29(v):
    return T.kill_count(v("runs").selectExpr("bundle", "CASE WHEN gate = 1 THEN NULL ELSE event_id END AS mutant", "status <> 'FAIL' AS passed"))


@query("d20_covered_changes", "WITH c AS (SELECT DISTINCT bundle, event_type AS file, event_id % 10 AS line FROM runs WHERE status = 'PASS'), h AS (SELECT bundle, event_type AS file, event_id % 10 AS line FROM runs WHERE status = 'FAIL') SELECT b.bundle, coalesce(n, 0) AS changed, coalesce(k, 0) AS covered, CASE WHEN n IS NULL THEN 'SKIP' WHEN coalesce(k, 0) = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (SELECT DISTINCT bundle FROM c) b LEFT JOIN (SELECT bundle, count(*) AS n FROM h GROUP BY 1) x USING (bundle) LEFT JOIN (SELECT bundle, count(*) AS k FROM h WHERE (bundle, file, line) IN (SELECT (bundle, file, line) FROM c) GROUP BY 1) y USING (bundle)")
def d20(v):
    r = v("runs").selectExpr("bundle", "event_type AS file", "event_id % 10 AS line", "status")
    return T.covered_changes(r.filter("status = 'PASS'"), r.filter("status = 'FAIL'"))


@query("e30_finding_report", "SELECT bundle, count(*) FILTER (status = 'FAIL') AS errors, count(*) FILTER (status = 'SKIP') AS warnings, count(*) FILTER (status = 'FAIL') = 0 AS ok FROM runs GROUP BY bundle")
def e30(v):
    return T.finding_report(v("runs").selectExpr("bundle", "CASE status WHEN 'FAIL' THEN 'ERROR' WHEN 'SKIP' THEN 'WARNING' ELSE 'INFO' END AS severity"))


@query("e30_finding_counts", "SELECT bundle, status AS severity, event_type AS rule, count(*) AS n FROM runs GROUP BY ALL")
def e30b(v):
    return T.finding_counts(v("runs").selectExpr("bundle", "status AS severity", "event_type AS rule"))


@query("e31_duplicate_steps", "SELECT type, pattern, site, n - 1 AS others FROM (SELECT p_type AS type, p_brand AS pattern, p_partkey AS site, count(*) OVER (PARTITION BY p_type, p_brand) AS n FROM part) x WHERE n > 1")
def e31(v):
    return T.duplicate_steps(v("part").selectExpr("p_type AS type", "p_brand AS pattern", "p_partkey AS site"))


@query("e32_spec_checklist", "SELECT c_mktsegment AS section, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS n, CASE WHEN count(CASE WHEN c_acctbal > 0 THEN 1 END) > 0 THEN 'present' ELSE 'missing' END AS status FROM customer GROUP BY 1")
def e32(v):
    return T.spec_checklist(v("customer").selectExpr("c_mktsegment AS section", "CASE WHEN c_acctbal > 0 THEN 1 END AS entry"))


_RULES = {"max_scenarios_per_feature": 4, "scenario_name_must_include": ["1", "On 2"], "required_tags": ["@t1", "@team"], "forbidden_tags": ["@t2", "@bad"], "require_feature_description": True, "severity": "WARNING"}


def _files(v):
    """Feature files: a tag line, the heading, a description or none, then tagged scenarios with their steps."""
    steps = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(" ", "keyword", F.regexp_replace("text", r"\s+", " ")).alias("t")))), lambda x: x["t"]), "\n")
    one = v("scenarios").groupBy("feature_file", "conv_id", "name").agg(steps.alias("steps")).withColumn("text", F.expr("concat('@t', conv_id % 3, ' @x\n Scenario', CASE WHEN conv_id % 2 = 0 THEN ' Outline' ELSE '' END, ': ', CASE WHEN conv_id % 7 = 0 THEN 'on 2' ELSE name END, '\n', steps, '\n')"))
    files = one.groupBy("feature_file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("conv_id", "text"))), lambda x: x["text"]), "").alias("body"))
    return files.select(F.col("feature_file").alias("file"), F.expr("concat('# note\n@team', CASE WHEN length(feature_file) % 2 = 0 THEN ' @bad' ELSE '' END, '\n\nFeature: f\n', CASE WHEN length(feature_file) % 2 = 0 THEN '' ELSE 'All about it\n' END, body)").alias("text"))


@query("i10_check_standards", """WITH c AS (SELECT feature_file, conv_id, CASE WHEN conv_id % 7 = 0 THEN 'on 2' ELSE name END AS name, count(*) AS n, length(feature_file) % 2 = 0 AS bad FROM scenarios GROUP BY ALL), s AS (SELECT *, (CASE WHEN bad THEN 4 ELSE 5 END + 2 + coalesce(sum(n + 2) OVER (PARTITION BY feature_file ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS line FROM c), f AS (SELECT feature_file, bad, count(*) AS n FROM s GROUP BY ALL),
 r AS (SELECT feature_file, 4::BIGINT AS line, NULL::VARCHAR AS name, 'max-scenarios' AS rule, NULL::VARCHAR AS symbol FROM f WHERE n > 4 UNION ALL SELECT feature_file, 4, NULL, 'feature-description', NULL FROM f WHERE bad UNION ALL SELECT feature_file, 4, NULL, 'forbidden-tag', '@bad' FROM f WHERE bad
 UNION ALL SELECT feature_file, line, name, 'required-tag', '@t1' FROM s WHERE conv_id % 3 <> 1 UNION ALL SELECT feature_file, line, name, 'scenario-name', NULL FROM s WHERE NOT contains(name, '1') UNION ALL SELECT feature_file, line, name, 'forbidden-tag', '@t2' FROM s WHERE conv_id % 3 = 2)
 SELECT feature_file, line, name, rule, 'WARNING' AS severity, symbol FROM r""")
def i10(v):
    return T.check_standards(*scan_headers(_files(v)), _RULES)


@query("i10_nothing_to_check", "SELECT NULL::VARCHAR AS feature_file, 'nothing-to-check' AS rule FROM (SELECT count(*) AS n FROM scenarios WHERE conv_id < 0) x WHERE n = 0")
def i10b(v):
    return T.check_standards(*scan_headers(_files(v).filter("file = 'none'")), _RULES).select("feature_file", "rule")


@query("g01_merge_facts", "WITH a AS (SELECT app_id, subject, predicate, object, 0 AS src FROM facts UNION ALL SELECT app_id, subject, predicate, object, 1 FROM templated UNION ALL SELECT app_id, subject, predicate, object, 2 FROM facts WHERE ord % 3 = 0) SELECT app_id, subject, predicate, object, min(src) AS source, count(*) AS n FROM a GROUP BY ALL")
def g01(v):
    f, t = v("facts").select("app_id", "subject", "predicate", "object", "ord"), v("templated").select("app_id", "subject", "predicate", "object", "ord")
    return T.merge_facts([f, t, f.filter("ord % 3 = 0")], ["app_id", "subject", "predicate", "object"])


@query("g04_id_diff", "SELECT c_custkey AS id, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def g04(v):
    return T.id_diff(v("customer").selectExpr("c_custkey AS id"), v("orders").selectExpr("o_custkey AS id"))


@query("g05_requirement_only", "SELECT DISTINCT o_custkey AS generated FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def g05(v):
    by = lambda status: v("orders").filter(f"o_orderstatus = '{status}'").selectExpr("o_custkey AS generated")
    return T.requirement_only(by("F"), by("O"))


@query("j01_cosine_topk", "SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id) x WHERE rank <= 5")
def j01(v):
    e = v("embeddings")
    return M.cosine_topk(e, e.filter("vec_id % 20 = 0")).select("query_id", "vec_id", "rank")


# the end of a span is the first row behind it that goes below its depth
_DEPTHS = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('signup', 'purchase', 'error')), r AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY k) AS s FROM e), l AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY k)) AS depth FROM r)"


@query("k01_assemble_spans", f"WITH {_DEPTHS}, c AS (SELECT a.*, (SELECT min(b.k) FROM l b WHERE b.user_id = a.user_id AND b.k > a.k AND b.depth < a.depth) AS ek, (SELECT max(b.k) FROM l b WHERE b.user_id = a.user_id AND b.k < a.k AND b.event_type = 'signup' AND b.depth = a.depth - 1) AS pk FROM l a WHERE event_type = 'signup') SELECT c.event_id AS span_id, c.user_id, x.event_id AS end_id, (epoch_us(x.ts) - epoch_us(c.ts)) // 1000 AS duration_ms, CASE WHEN x.event_id IS NULL THEN 'unclosed' WHEN x.event_type = 'error' THEN 'fail' ELSE 'ok' END AS status, p.event_id AS parent_id FROM c LEFT JOIN l x ON x.user_id = c.user_id AND x.k = c.ek LEFT JOIN l p ON p.user_id = c.user_id AND p.k = c.pk")
def k01(v):
    from ..streaming.spans import close_spans

    return close_spans(v("events")).drop("start", "end")


@query("k02_mark_stale", "SELECT id, CASE WHEN hit THEN 'stale' ELSE status END AS status, hit AS changed FROM (SELECT *, coalesce(status = 'open' AND id % 2 >= 0 AND (app_id, unit) IN (SELECT app_id, unit FROM feedback WHERE id % 40 = 0 AND unit IS NOT NULL), FALSE) AS hit FROM feedback) x")
def k02b(v):
    from ..streaming.spans import mark_stale

    return mark_stale(v("feedback"), v("feedback").filter("id % 40 = 0")).select("id", "status", "changed")


@query("k02_set_status", "SELECT id, CASE WHEN id % 3 = 0 THEN 'applied' ELSE status END AS status, id % 3 = 0 AND status <> 'applied' AS changed FROM feedback")
def k02c(v):
    from ..streaming.spans import set_status

    return set_status(v("feedback"), v("feedback").filter("id % 3 = 0"), "applied").select("id", "status", "changed")


@query("k02_feedback_state", "SELECT app_id, unit, arg_max(status, (created_at, id)) AS status, count(*) AS events FROM feedback WHERE unit IS NOT NULL GROUP BY ALL")
def k02(v):
    from ..streaming.spans import feedback_state

    return feedback_state(v("feedback").filter("unit IS NOT NULL"))
