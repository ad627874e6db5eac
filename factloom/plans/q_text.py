"""Queries for text jobs, over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import text as X
from .q_scalars import _INTENT, _labels, _norm, _stage
from .registry import query


@query("f03_carry_forward", "SELECT doc_id, pos, last_value(CASE WHEN length(line) % 5 = 0 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM doc_lines")
def f03(v):
    return X.carry_forward(v("doc_lines"), F.when(F.length("line") % 5 == 0, F.col("pos")), "head", "doc_id").select("doc_id", "pos", "head")


@query("f04_number_items", "SELECT doc_id, pos, number FROM (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM doc_lines) x WHERE length(line) > 60")
def f04(v):
    return X.number_items(v("doc_lines"), ["doc_id"]).filter(F.length("line") > 60).select("doc_id", "pos", "number")


_MARKED = "SELECT doc_id AS file, pos, CASE WHEN length(line) % 4 = 0 THEN '## ' || left(line, 12) ELSE line END AS line FROM doc_lines"


def _marked(v):
    line = F.when(F.length("line") % 4 == 0, F.concat(F.lit("## "), F.left("line", F.lit(12)))).otherwise(F.col("line"))
    rows = v("doc_lines").select("doc_id", "pos", line.alias("line"))
    return rows.groupBy(F.col("doc_id").alias("file")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query("i02_md_sections", f"WITH m AS ({_MARKED}), h AS (SELECT *, last_value(CASE WHEN line LIKE '## %' THEN pos END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hd FROM m), s AS (SELECT file, hd, max(trim(substring(line, 4))) FILTER (pos = hd) AS section, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (pos > hd), '') AS body FROM h WHERE hd IS NOT NULL GROUP BY file, hd) SELECT file, section, arg_max(body, hd) AS body FROM s GROUP BY file, section")
def i02(v):
    return X.md_sections(_marked(v)).drop("at")


# sections by line number: stories, requirements, functions, gaps, metadata and extras
_SECTION = "CASE doc_id % 4 WHEN 0 THEN CASE pos % 3 WHEN 0 THEN '1. User Stories' WHEN 1 THEN 'Consolidated Requirements' ELSE 'Gap Analysis' END WHEN 1 THEN 'Gap Analysis' WHEN 2 THEN 'Notes' ELSE CASE pos % 2 WHEN 0 THEN 'System Overview' ELSE 'Function Specification' END END"
_WORD = "trim(regexp_replace(line, '[^A-Za-z0-9 ]', ''{all}))"
# every second requirement has the words of the line before it, which may be a story's
_SAID = "CASE WHEN pos % 2 = 0 THEN w ELSE coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), w) END"


def _sections(v):
    # the same as _WORD: what to keep is found some five times as fast as what to drop
    word = F.trim(F.array_join(F.regexp_extract_all("line", F.lit("([A-Za-z0-9 ]+)"), F.lit(1)), ""))
    rows = v("doc_lines").select("doc_id", "pos", F.expr(_SECTION).alias("section"), word.alias("w")).withColumn("said", F.expr(_SAID))
    item = "CASE pos % 5 WHEN 0 THEN concat(pos + 1, '. Given ', w, ' when x then y', CASE WHEN pos % 3 = 0 THEN ' (negative path)' ELSE '' END) WHEN 1 THEN concat('- The system shall ', CASE WHEN pos % 4 = 2 THEN 'enforce the rule 3 ' ELSE '' END, said, ' z') WHEN 2 THEN concat('- Gap: ', w, ' z') WHEN 3 THEN concat('| f', pos % 7, ' | ', w, ' q | n/a |') ELSE CASE WHEN pos % 10 = 4 THEN concat('### US-', pos, ': ', w) ELSE '- plain' END END"
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), "\n")
    return rows.withColumn("item", F.expr(item)).groupBy(F.col("doc_id").alias("file"), "section").agg(F.min("pos").alias("at"), F.concat(F.lit("| Function | Does | Not |\n|---|:--|---|\n"), body).alias("body"))


_LABEL = "left(trim(regexp_replace(story || '-AC-' || (pos + 1), '[^A-Za-z0-9_-]+', '-', 'g'), '-'), 80)"
_ITEMS = f"""raw AS (SELECT *, {_SAID} AS said FROM (SELECT doc_id, doc_id AS file, pos, {_SECTION} AS section, {_WORD.format(all=", 'g'")} AS w FROM doc_lines) x),
 led AS (SELECT *, min(pos) OVER (PARTITION BY file, section) AS first_pos, last_value(CASE WHEN pos % 10 = 4 THEN 'US-' || pos || ': ' || w END IGNORE NULLS) OVER (PARTITION BY file, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head, bool_or(pos % 10 = 4) OVER (PARTITION BY file, section) AS led FROM raw),
 acs AS (SELECT file, pos, section, first_pos, trim(coalesce(head, 'US-general')) AS story, trim('Given ' || w || ' when x then y' || CASE WHEN pos % 3 = 0 THEN ' (negative path)' ELSE '' END) AS text FROM led WHERE pos % 5 = 0 AND section IN ('1. User Stories', 'Notes') AND (head IS NOT NULL OR NOT led)),
 it AS (SELECT file, pos, section, first_pos, 'primary' AS tier, 1 AS rank, story, {_LABEL} AS label, text FROM acs
 UNION ALL SELECT file, pos, section, first_pos, 'primary', 2, 'consolidated', 'REQ-' || row_number() OVER (PARTITION BY file, section ORDER BY pos), 'The system shall ' || ltrim(CASE WHEN pos % 4 = 2 THEN 'enforce the rule 3 ' ELSE '' END || said || ' z') FROM led WHERE pos % 5 = 1 AND section IN ('Consolidated Requirements', 'Notes')
 UNION ALL SELECT file, pos, section, first_pos, 'secondary', 3, 'functions', 'FN-' || row_number() OVER (PARTITION BY file, section ORDER BY pos), 'Function=f' || (pos % 7) || ' | Does=' || trim(w || ' q') FROM led WHERE pos % 5 = 3 AND section = 'Function Specification'
 UNION ALL SELECT file, pos, section, first_pos, 'secondary', 4, 'gaps', 'GAP-' || row_number() OVER (PARTITION BY file, section ORDER BY pos), trim(w || ' z') FROM led WHERE pos % 5 = 2 AND section IN ('Gap Analysis', 'Notes'))"""


def _stories(v):
    return _sections(v).filter("section IN ('1. User Stories', 'Notes')")


@query("i03_story_acs", f"WITH {_ITEMS} SELECT file, section, story, label, text, contains(text, '(negative') AS negative FROM it WHERE rank = 1")
def i03(v):
    return X.story_acs(_stories(v)).select("file", "section", "story", "label", "text", "negative")


@query("i03_whole_stories", f"WITH {_ITEMS}, b AS (SELECT file, section, story, count(*) AS n, min(pos) AS first, string_agg('AC-' || (pos + 1) || ': ' || text, chr(10) ORDER BY pos) AS every, min(text) AS one FROM acs GROUP BY ALL) SELECT file, section, story, left(trim(regexp_replace(story || CASE WHEN n = 1 THEN '-AC-' || (first + 1) ELSE '-aggregated' END, '[^A-Za-z0-9_-]+', '-', 'g'), '-'), 80) AS label, CASE WHEN n = 1 THEN one ELSE every END AS text FROM b")
def i03b(v):
    return X.story_acs(_stories(v), aggregate=True).select("file", "section", "story", "label", "text")


@query("i04_shall_items", f"WITH {_ITEMS} SELECT file, section, label, text FROM it WHERE rank = 2")
def i04(v):
    return X.shall_items(_sections(v).filter("section IN ('Consolidated Requirements', 'Notes')")).select("file", "section", "label", "text")


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2))"


@query("i04_new_requirements", f"WITH {_ITEMS}, r AS (SELECT file, section, label, text, {_TOKENS} AS a FROM it WHERE rank = 2 AND section = 'Consolidated Requirements'), s AS (SELECT file, {_TOKENS} AS b FROM acs WHERE section = '1. User Stories') SELECT file, section, label, text FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.file = r.file AND (regexp_matches(lower(text), '\\benforce\\b.+\\brule\\s+\\d+\\b') OR len(list_intersect(a, b)) / least(len(a), len(b)) >= 0.55))")
def i04b(v):
    s = _sections(v)
    return X.shall_items(s.filter("section = 'Consolidated Requirements'"), X.story_acs(s.filter("section = '1. User Stories'"))).select("file", "section", "label", "text")


@query("i05_table_items", f"WITH {_ITEMS} SELECT file, section, label, text FROM it WHERE rank = 3")
def i05(v):
    return X.table_items(_sections(v).filter("section = 'Function Specification'")).select("file", "section", F.concat(F.lit("FN-"), F.col("number").cast("string")).alias("label"), "text")


@query("i06_gap_items", f"WITH {_ITEMS} SELECT file, section, label, text FROM it WHERE rank = 4")
def i06(v):
    return X.gap_items(_sections(v).filter("section IN ('Gap Analysis', 'Notes')")).select("file", "section", "label", "text")


@query("i07_section_items", f"WITH {_ITEMS} SELECT file, section, tier, story, label, text FROM (SELECT *, row_number() OVER (PARTITION BY file, left(sha256(trim(text)), 12) ORDER BY first_pos, section, rank, pos) AS k FROM it) y WHERE k = 1")
def i07(v):
    return X.section_items(_sections(v)).drop("negative")


_CORPUS = _norm("file || ' ' || story || ' ' || text")
_BY_ID = _norm("file || '::' || section || '::' || label")


@query("i08_profile_items", f"WITH {_ITEMS}, c AS (SELECT file, label, section, text, {_CORPUS} AS c, {_BY_ID} AS t FROM it WHERE rank = 1), p AS (SELECT *, coalesce({_stage('c')}, 'general') AS stage, CASE WHEN contains(text, '(negative') THEN 'negative' ELSE {_INTENT} END AS intent, {_labels('c', vocab.ACTION_PHRASES)} AS actions FROM c) SELECT file || '::' || section || '::' || label AS item_id, stage, intent, actions, list_sort(list_distinct(list_concat(list_transform(actions, lambda a: 'expect_' || a), list_filter([CASE WHEN intent = 'negative' THEN 'expect_stop' END, CASE WHEN list_contains(actions, 'notify') THEN 'expect_notify' END], lambda x: x IS NOT NULL)))) AS outcomes FROM p")
def i08(v):
    return X.profile_items(X.story_acs(_stories(v))).select("item_id", "stage", "intent", "actions", "outcomes")


@query("e22_extraction_report", f"WITH {_ITEMS}, s AS (SELECT DISTINCT file, section FROM raw), n AS (SELECT file, count(*) FILTER (tier = 'primary') AS p, count(*) FILTER (tier = 'secondary') AS s, count(*) FILTER (rank = 4 AND section = 'Gap Analysis') AS g FROM it GROUP BY file) SELECT s.file, coalesce(max(p), 0) AS primary, coalesce(max(n.s), 0) AS secondary, CASE WHEN coalesce(max(p), 0) = 0 THEN coalesce(max(g), 0) ELSE 0 END AS fallback, count(*) FILTER (section = 'System Overview') AS skipped FROM s LEFT JOIN n USING (file) GROUP BY s.file")
def e22(v):
    return X.extraction_report(_sections(v))


_FEATURE = "concat('Feature: f', conv_id % 20, '\nBackground:\n  Given base\n# note\nScenario: s', conv_id, '\n', steps)"


def _features(v):
    s = v("scenarios").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "keyword", F.regexp_replace("text", "\n", " ").alias("text")))), lambda x: F.concat_ws(" ", F.lit(" "), x["keyword"], x["text"])), "\n").alias("steps"))
    return s.selectExpr("conv_id AS file", f"{_FEATURE} AS text")


@query("i01_parse_features", "SELECT conv_id AS file, keyword, count(*) AS n FROM (SELECT conv_id, keyword FROM scenarios UNION ALL SELECT DISTINCT conv_id, 'Given' FROM scenarios) x GROUP BY ALL")
def i01(v):
    return X.parse_features(_features(v))[1].groupBy("file", "keyword").agg(F.count("*").alias("n"))


_TAGGED = "concat('Feature: f', o_custkey % 20, '\n@old\nBackground:\n  Given base\n@p', o_orderkey % 3, ' @rest\n@q\n', CASE WHEN o_orderkey % 2 = 0 THEN 'Scenario Outline: s' ELSE 'Scenario: s' END, o_orderkey, '\n  Given <a>\n', CASE WHEN o_orderkey % 2 = 0 THEN concat('Examples:\n | a | b |\n |---|---|\n | ', o_custkey, ' | x |\n') ELSE '' END, '@lost\n  Then done\nScenario: t', o_orderkey, '\n  * any\n')"


@query("i01_scenarios", "SELECT o_orderkey AS file, 'f' || (o_custkey % 20) AS feature, 's' || o_orderkey AS scenario, o_orderkey % 2 = 0 AS outline, 'p' || (o_orderkey % 3) || ',q' AS tags, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b;' || o_custkey || ',x' ELSE '' END AS examples FROM orders UNION ALL SELECT o_orderkey, 'f' || (o_custkey % 20), 't' || o_orderkey, FALSE, '', '' FROM orders")
def i01b(v):
    s = X.parse_features(v("orders").selectExpr("o_orderkey AS file", f"{_TAGGED} AS text"))[0]
    return s.select("file", "feature", "scenario", "outline", F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("examples", lambda r: F.array_join(r, ",")), ";").alias("examples"))


_DIFF = "concat('--- a/x', o_custkey % 3, '\n+++ b/x', o_custkey % 3, '\n@@ -1,3 +', o_custkey % 50 + 1, ',4 @@\n keep\n-gone\n+new one\n keep\n+new two')"


@query("i09_added_lines", "SELECT o_orderkey AS file, 'x' || (o_custkey % 3) AS target, CAST(o_custkey % 50 + 1 + k AS INTEGER) AS line FROM orders, (VALUES (1), (3)) t(k)")
def i09(v):
    return X.added_lines(v("orders").selectExpr("o_orderkey AS file", f"{_DIFF} AS text"))


@query("f05_f06_primary_file", "SELECT o_orderkey AS file, 'x' || (o_custkey % 3) AS primary FROM orders")
def f06(v):
    return X.primary_file(X.added_lines(v("orders").selectExpr("o_orderkey AS file", f"{_DIFF} AS text")))


@query("i11_harvest_env", "SELECT c_custkey AS file, 'NAME' AS token, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'SEG', c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def i11(v):
    m = F.create_map(F.lit("NAME"), F.col("c_name"), F.lit("SEG"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("${SEG}")))
    return X.harvest_env(v("customer").select(F.col("c_custkey").alias("file"), m.alias("environment")))


@query("a14_search_source", "SELECT 'src/' || CASE doc_id % 3 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'a/' ELSE '' END || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.txt' END AS file, pos, left(line, 200) AS line FROM doc_lines WHERE regexp_matches(line, 'tion|ent') AND doc_id % 2 = 0 AND doc_id % 3 <> 0 ORDER BY file, pos LIMIT 50")
def a14(v):
    name = F.expr("concat('src/', CASE doc_id % 3 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'a/' ELSE '' END, doc_id, CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.txt' END)")
    return X.search_source(v("doc_lines").withColumn("file", name), "tion|ent", glob="*.py")


_TEXTS = r"CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat(event_id, ';\n\n') ELSE concat(event_id, ';') END AS text"


@query("e36_confirmed_sections", "WITH e AS (SELECT user_id AS unit, event_id AS ord, event_type AS section, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_id || ';' END AS text, CASE WHEN event_id % 3 = 0 THEN event_id END AS fid FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY unit, section ORDER BY ord) AS k FROM e WHERE fid IS NULL OR fid % 2 = 0) SELECT unit, section, string_agg(text, chr(10) || chr(10) ORDER BY ord) FILTER (text <> '' OR k = 1) || chr(10) AS body, coalesce(bool_or(fid % 2 = 0), FALSE) AS confirmed FROM r GROUP BY ALL")
def e36b(v):
    e = v("events").selectExpr("user_id AS unit", "event_id AS ord", "'text' AS kind", "event_type AS section", _TEXTS, "CASE WHEN event_id % 3 = 0 THEN event_id END AS feedback_id")
    edge = lambda kind, ord_: v("events").select(F.col("user_id").alias("unit")).distinct().select("unit", F.lit(ord_).cast("long").alias("ord"), F.lit(kind).alias("kind"), F.lit("").alias("section"), F.lit("").alias("text"), F.lit(None).cast("long").alias("feedback_id"))
    return X.assemble_docs(e.unionByName(edge("open", -1)).unionByName(edge("finish", 1 << 60)), v("events").filter("event_id % 2 = 0").selectExpr("event_id AS id"))


_CANON = "(VALUES " + ", ".join(f"({n}, '{s}')" for n, s in enumerate(vocab.SECTIONS, 1)) + ") c(n, section)"
_HAS = "CASE p_size % 7 WHEN 0 THEN '6. User Stories' WHEN 1 THEN 'gap analysis' WHEN 2 THEN 'System Overview' ELSE concat('Extra ', chr(65 + p_size % 5)) END"


@query("b31_render_docs", f"""WITH s AS (SELECT p_brand AS unit, {_HAS} AS section, min(p_partkey) AS pos, CASE WHEN p_size % 7 = 1 THEN '  ' ELSE min(p_name) END AS body FROM part GROUP BY p_brand, p_size % 7, 2),
 m AS (SELECT unit, section, min(pos) AS pos, arg_max(trim(body), pos) AS body FROM s GROUP BY ALL),
 f AS (SELECT u.unit, n, c.section, body FROM (SELECT DISTINCT p_brand AS unit FROM part) u, {_CANON} LEFT JOIN m ON m.unit = u.unit AND lower(c.section) = lower(regexp_replace(m.section, '^6. ', ''))
 UNION ALL SELECT unit, 9 + row_number() OVER (PARTITION BY unit ORDER BY pos, section), section, body FROM m WHERE section LIKE 'Extra%'),
 t AS (SELECT unit, string_agg('## ' || n || '. ' || section || chr(10) || chr(10) || coalesce(nullif(body, ''), '_(none)_') || chr(10) || chr(10), '' ORDER BY n) AS text FROM f GROUP BY unit),
 g AS (SELECT p_brand AS unit, string_agg('`' || p_type || '`', ', ' ORDER BY p_partkey) AS names FROM part WHERE p_size % 5 = 0 GROUP BY 1)
 SELECT unit, '# Requirement Document: ' || CASE WHEN unit LIKE '%1' THEN 'Title' ELSE unit END || chr(10) || chr(10) || '**Unit:** `' || unit || '`  ·  **Type:** Unknown' || chr(10) || chr(10) || '**Provenance:** code-derived  ·  **Requirement-backed:** no  ·  **Confidence:** ' || CASE WHEN unit LIKE '%2' THEN '0.25' ELSE 'n/a (code-derived)' END || chr(10) || '**Grounding:** _(not recorded)_' || chr(10) || chr(10) || text || '---' || chr(10) || '**Grounded identifiers (re-checked at the boundary):** ' || coalesce(names, '_(none)_') || chr(10) AS markdown FROM t LEFT JOIN g USING (unit)""")
def b31(v):
    p = v("part")
    docs = p.select(F.col("p_brand").alias("unit")).distinct().selectExpr("unit", "CASE WHEN unit LIKE '%1' THEN 'Title' ELSE '' END AS title", "CAST(NULL AS STRING) AS unit_type", "'code-derived' AS provenance", "FALSE AS requirement_backed", "CASE WHEN unit LIKE '%2' THEN 0.25D END AS confidence", "'' AS grounding")
    sections = p.groupBy(F.col("p_brand").alias("unit"), (F.col("p_size") % 7).alias("k"), F.expr(_HAS).alias("section")).agg(F.min("p_partkey").alias("pos"), F.when(F.col("k") == 1, "  ").otherwise(F.min("p_name")).alias("body"))
    return X.render_docs(docs, sections, p.filter("p_size % 5 = 0").selectExpr("p_brand AS unit", "p_partkey AS ord", "p_type AS name"))


@query("e36_assemble_docs", "WITH e AS (SELECT user_id AS unit, event_id AS ord, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'finish' ELSE 'text' END AS kind, event_type AS section, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_id || ';' END AS text FROM events), o AS (SELECT *, last_value(CASE WHEN kind = 'open' THEN ord END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened FROM e), l AS (SELECT unit, max(ord) AS opened FROM e WHERE kind = 'open' GROUP BY unit) SELECT unit, section, string_agg(text, chr(10) || chr(10) ORDER BY ord) FILTER (text <> '' OR k = 1) || chr(10) AS body FROM (SELECT o.*, row_number() OVER (PARTITION BY o.unit, section ORDER BY ord) AS k FROM o JOIN l ON o.unit = l.unit AND o.opened = l.opened WHERE kind = 'text' AND EXISTS (SELECT 1 FROM o f WHERE f.kind = 'finish' AND f.unit = o.unit AND f.opened = o.opened)) x GROUP BY unit, section")
def e36(v):
    e = v("events").selectExpr("user_id AS unit", "event_id AS ord", "CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'finish' ELSE 'text' END AS kind", "event_type AS section", _TEXTS)
    return X.assemble_docs(e).drop("confirmed")
