"""Queries over the flow graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import graph as G
from .registry import query


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


FLOW = f"flow AS MATERIALIZED (SELECT DISTINCT CASE WHEN predicate IN {_in(vocab.FORWARD)} THEN subject ELSE object END AS src, CASE WHEN predicate IN {_in(vocab.FORWARD)} THEN object ELSE subject END AS dst FROM facts WHERE predicate IN {_in(vocab.FORWARD + vocab.REVERSED)})"
INDEG = f"indeg AS (SELECT dst AS node, count(*) FILTER (p NOT IN {_in(vocab.READS)}) AS indegree FROM (SELECT src, dst, arg_min(predicate, ord) AS p FROM (SELECT ord, predicate, CASE WHEN predicate IN {_in(vocab.FORWARD)} THEN subject ELSE object END AS src, CASE WHEN predicate IN {_in(vocab.FORWARD)} THEN object ELSE subject END AS dst FROM facts WHERE predicate IN {_in(vocab.FORWARD + vocab.REVERSED)}) x GROUP BY src, dst) y GROUP BY dst)"
ENTRY = f"entry AS MATERIALIZED (SELECT DISTINCT src AS node FROM flow WHERE (src IN (SELECT subject FROM facts WHERE predicate IN {_in(vocab.FORWARD)}) OR src IN (SELECT object FROM facts WHERE predicate IN {_in(vocab.ENTRIES)})) AND src NOT IN (SELECT node FROM indeg WHERE indegree > 0))"
WALKS = "reach AS (SELECT node AS entry, node, 0 AS hop FROM entry UNION SELECT r.entry, f.dst, r.hop + 1 FROM reach r JOIN flow f ON r.node = f.src), walks AS MATERIALIZED (SELECT entry, node, min(hop) AS hop FROM reach WHERE entry <> node GROUP BY ALL)"
DOOR = f"door AS (SELECT DISTINCT object AS entry FROM facts WHERE predicate IN {_in(vocab.ENTRIES)})"
WIDE = "wide AS (SELECT entry AS other, node FROM walks UNION SELECT DISTINCT entry, entry FROM walks), size AS (SELECT entry, count(*) AS n FROM walks GROUP BY entry)"
HELD = "held AS (SELECT w.entry, o.other FROM walks w JOIN wide o ON w.node = o.node AND w.entry <> o.other WHERE w.entry NOT IN (SELECT entry FROM door) OR o.other IN (SELECT entry FROM door) GROUP BY w.entry, o.other HAVING count(*) = (SELECT n FROM size s WHERE s.entry = w.entry))"
ALIKE = "alike AS (SELECT h.entry, h.other FROM held h JOIN walks a ON a.entry = h.entry JOIN walks b ON b.entry = h.other AND a.node = b.node GROUP BY h.entry, h.other HAVING count(*) = (SELECT n FROM size s WHERE s.entry = h.entry) AND count(*) = (SELECT n FROM size s WHERE s.entry = h.other))"
SUBSUMED = "subsumed AS (SELECT DISTINCT h.entry FROM held h LEFT JOIN alike a ON h.entry = a.entry AND h.other = a.other WHERE NOT (a.entry IS NOT NULL AND NOT EXISTS (SELECT 1 FROM wide x WHERE x.other = h.other AND x.node = h.entry) AND h.entry < h.other))"
KINDS = f"kinds AS (SELECT w.entry, count(*) AS members, max(hop) AS depth, CASE WHEN count(*) >= 2 AND (bool_or(node LIKE 'State:%' OR node LIKE 'StateMachine:%') OR max(hop) >= 4 OR w.entry IN (SELECT entry FROM (SELECT x.entry, f.object FROM walks x JOIN facts f ON x.node = f.subject GROUP BY ALL HAVING bool_or(predicate IN {_in(vocab.WRITES)}) AND bool_or(predicate IN {_in(vocab.READS)})) y)) THEN 'journey' ELSE 'behavior' END AS kind FROM walks w GROUP BY w.entry)"
OWNER = r"own AS (SELECT e.entry, CASE WHEN e.entry IN (SELECT id FROM entities) THEN e.entry ELSE (SELECT arg_min(node, (hop, node)) FROM walks w WHERE w.entry = e.entry AND w.node IN (SELECT id FROM entities)) END AS brick FROM (SELECT DISTINCT entry FROM walks) e), family AS (SELECT entry, CASE WHEN brick IS NULL THEN entry ELSE regexp_replace(substring(brick, position(':' in brick) + 1), '\.[^.]*$', '') END AS family FROM own)"


@query("h01_flow_edges", f"WITH {FLOW} SELECT src, dst FROM flow")
def h01(v):
    return G.flow_edges(v("facts"))


@query("h02_strict_indegree", f"WITH {INDEG} SELECT node, indegree FROM indeg")
def h02(v):
    return G.strict_indegree(v("facts"))


@query("h03_entry_points", f"WITH {FLOW}, {INDEG}, {ENTRY} SELECT node FROM entry")
def h03(v):
    return G.entry_points(v("facts"))


@query("h04_bfs", f"WITH RECURSIVE {FLOW}, {INDEG}, {ENTRY}, {WALKS} SELECT entry, node, hop FROM walks")
def h04(v):
    return G.walks(v("facts"))


@query("h05_subsume", f"WITH RECURSIVE {FLOW}, {INDEG}, {ENTRY}, {WALKS}, {DOOR}, {WIDE}, {HELD}, {ALIKE}, {SUBSUMED} SELECT entry FROM subsumed")
def h05(v):
    g = G.flow(v("facts"))
    starts = G.entries(g)
    held = G.subsume(G.spread(g.edges, starts), starts.filter("door"))
    return starts.join(held.hint("merge"), "entry", "left_semi").select(F.col("name").alias("entry"))


@query("h06_classify", f"WITH RECURSIVE {FLOW}, {INDEG}, {ENTRY}, {WALKS}, {KINDS} SELECT entry, members, depth, kind FROM kinds")
def h06(v):
    g = G.flow(v("facts"))
    starts = G.entries(g)
    kinds = G.classify(G.spread(g.edges, starts), g)
    return starts.join(kinds.hint("merge"), "entry").select(F.col("name").alias("entry"), "members", "depth", "kind")


@query("h07_owner", f"WITH RECURSIVE {FLOW}, {INDEG}, {ENTRY}, {WALKS}, {OWNER} SELECT entry, family FROM family")
def h07(v):
    return G.owner(v("facts"), v("entities"))


JOURNEYS = f"{FLOW}, {INDEG}, {ENTRY}, {WALKS}, {DOOR}, {WIDE}, {HELD}, {ALIKE}, {SUBSUMED}, {KINDS}, {OWNER}, journeys AS MATERIALIZED (SELECT k.entry, CASE WHEN kind = 'journey' AND k.entry NOT IN (SELECT entry FROM door) THEN 'unwired' ELSE kind END AS kind, members, depth, family FROM kinds k JOIN family USING (entry) WHERE k.entry NOT IN (SELECT entry FROM subsumed))"


@query("h08_journeys", f"WITH RECURSIVE {JOURNEYS} SELECT entry, kind, members, depth, family FROM journeys")
def h08(v):
    return G.journeys(v("facts"), v("entities"))


@query("h08_members", f"WITH RECURSIVE {JOURNEYS}, named AS (SELECT *, CASE kind WHEN 'journey' THEN 'Journey:' || entry ELSE 'BehaviorGroup:' || family END AS subject FROM journeys WHERE kind <> 'unwired'), out AS (SELECT subject, CASE kind WHEN 'journey' THEN 'STARTS_AT' ELSE 'HAS_MEMBER' END AS predicate, entry AS object, CASE WHEN kind <> 'journey' THEN 0 END AS line, TRUE AS resolved FROM named UNION ALL SELECT subject, 'HAS_MEMBER', node, hop, NOT contains(node, '$' || chr(123)) FROM walks JOIN named USING (entry)) SELECT *, CASE WHEN resolved THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM out")
def h08_members(v):
    return G.journey_facts(v("facts"), v("entities"))


@query("h09_walk", "WITH e AS (SELECT DISTINCT subject AS src, predicate AS relation, object AS dst FROM facts WHERE predicate IN ('CALLS', 'WRITES_DATABASE')), one AS (SELECT *, 1 AS hop FROM e WHERE src LIKE 'Function:nation.%'), two AS (SELECT *, 2 AS hop FROM e WHERE src IN (SELECT dst FROM one)), three AS (SELECT *, 3 AS hop FROM e WHERE src IN (SELECT dst FROM two)) SELECT src, relation, dst, min(hop) AS hop FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) x GROUP BY ALL ORDER BY hop, src, relation, dst LIMIT 300")
def h09(v):
    f = v("facts")
    seeds = f.filter("subject LIKE 'Function:nation.%'").select(F.col("subject").alias("node"))
    return G.walk(f, seeds, ("CALLS", "WRITES_DATABASE"), 3, "out", 300)


@query("h09_walk_in_app", "WITH e AS (SELECT DISTINCT subject AS src, predicate AS relation, object AS dst FROM facts WHERE app_id = 'events'), one AS (SELECT *, 1 AS hop FROM e WHERE dst LIKE 'S3Object:click/%') SELECT src, relation, dst, hop FROM one ORDER BY hop, src, relation, dst LIMIT 100")
def h09b(v):
    f = v("facts")
    return G.walk(f, f.filter("object LIKE 'S3Object:click/%'").select(F.col("object").alias("node")), None, 1, "in", 100, "events")


@query("h10_longest_chain", f"WITH RECURSIVE {FLOW}, {INDEG}, {ENTRY}, {WALKS}, top AS (SELECT entry, node, hop FROM walks ORDER BY hop DESC, entry, node LIMIT 1), back AS (SELECT entry, node, hop FROM top UNION ALL SELECT b.entry, (SELECT min(f.src) FROM flow f JOIN (SELECT entry, node, hop FROM walks UNION ALL SELECT node, node, 0 FROM entry) w ON w.entry = b.entry AND w.node = f.src AND w.hop = b.hop - 1 WHERE f.dst = b.node), b.hop - 1 FROM back b WHERE b.hop > 0) SELECT hop AS step, node FROM back")
def h10(v):
    return G.chain(v("facts"))


@query("h11_dead_ends", f"WITH {FLOW}, n AS (SELECT subject AS node FROM facts UNION SELECT object FROM facts) SELECT node, kind FROM (SELECT DISTINCT object AS node, 'target' AS kind FROM facts WHERE predicate IN ('CALLS', 'QUERIES_DATABASE') UNION ALL SELECT node, 'named' FROM n WHERE node LIKE 'APIEndpoint:%' OR node LIKE 'S3Object:%' OR node LIKE 'Module:%') x WHERE node NOT IN (SELECT src FROM flow)")
def h11(v):
    return G.dead_ends(v("facts"), ("CALLS", "QUERIES_DATABASE"), ("APIEndpoint", "S3Object", "Module"))


@query("h08_entities", f"WITH RECURSIVE {JOURNEYS} SELECT DISTINCT CASE kind WHEN 'journey' THEN 'Journey:' || entry ELSE 'BehaviorGroup:' || family END AS id, CASE kind WHEN 'journey' THEN 'Journey' ELSE 'BehaviorGroup' END AS type, CASE kind WHEN 'journey' THEN entry ELSE family END AS name FROM journeys WHERE kind <> 'unwired'")
def h08_entities(v):
    return G.journey_entities(v("facts"), v("entities"))


_RES = " ".join(f"UNION ALL SELECT app_id || ':{label}:' || substring(object, position(':' in object) + 1), '{label}', 3, substring(object, position(':' in object) + 1), app_id, {extra} FROM facts WHERE predicate IN {_in(preds)}" for (label, preds), extra in zip(G.RESOURCES, ("'kind=exposed'", "'resolved=' || CASE WHEN contains(object, '$' || chr(123)) THEN 'False' ELSE 'True' END", "''", "''")))
_NODES = f"raw AS (SELECT DISTINCT app_id AS id, 'Application' AS label, 0 AS rank, app_id AS name, app_id, '' AS said FROM entities UNION ALL SELECT app_id || ':Component:' || split_part(file_path, '/', 2), 'Component', 1, split_part(file_path, '/', 2), app_id, 'entity_count=' || count(*) FROM entities GROUP BY app_id, split_part(file_path, '/', 2) UNION ALL SELECT app_id || ':' || id, type, 2, name, app_id, 'file_path=' || file_path FROM entities {_RES} UNION ALL SELECT app_id || ':' || subject, split_part(subject, ':', 1), 4, substring(subject, position(':' in subject) + 1), app_id, '' FROM facts UNION ALL SELECT app_id || ':' || object, split_part(object, ':', 1), 4, substring(object, position(':' in object) + 1), app_id, '' FROM facts), nodes AS (SELECT id, arg_min(label, rank) AS label, min(rank) AS rank, arg_min(name, rank) AS name, min(app_id) AS app_id, arg_min(said, rank) AS said FROM raw GROUP BY id)"
_GEDGES = "gedges AS (SELECT src, label, dst, app_id, left(sha256(src || '|' || label || '|' || dst), 16) AS id, arg_max(said, ord) AS said FROM (SELECT app_id AS src, 'CONTAINS' AS label, app_id || ':Component:' || split_part(file_path, '/', 2) AS dst, app_id, -1 AS ord, '' AS said FROM entities UNION ALL SELECT app_id || ':Component:' || split_part(file_path, '/', 2), 'DEFINES', app_id || ':' || id, app_id, -1, '' FROM entities UNION ALL SELECT app_id || ':' || subject, predicate, app_id || ':' || object, app_id, ord, resolved || ' ' || extraction_method || ' ' || (confidence IS NULL) FROM facts) x GROUP BY src, label, dst, app_id)"


def _said(df):
    """One text of the properties that the SQL has too."""
    p = F.col("properties")
    one = lambda k: F.concat(F.lit(f"{k}="), p[k])
    return df.withColumn("said", F.coalesce(*[one(k) for k in ("entity_count", "file_path", "kind", "resolved")], F.lit(""))).drop("properties")


@query("h12_graph_nodes", f"WITH {_NODES} SELECT * FROM nodes")
def h12(v):
    return _said(G.graph_tables(v("facts"), v("entities"))[0])


@query("h12_graph_edges", f"WITH {_GEDGES} SELECT * FROM gedges")
def h12e(v):
    p = F.col("properties")
    said = F.coalesce(F.concat_ws(" ", p["resolved"], p["extraction_method"], F.when(p["resolved"].isNotNull(), p["confidence"].isNull().cast("string"))), F.lit(""))
    return G.graph_tables(v("facts"), v("entities"))[1].withColumn("said", said).drop("properties")


@query("h13_drop_app", f"WITH {_NODES} SELECT * FROM nodes WHERE app_id <> 'events'")
def h13(v):
    return _said(G.drop_app(*G.graph_tables(v("facts"), v("entities")), "events")[0])
