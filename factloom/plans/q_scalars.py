"""Scalar functions over facts, templates, scenarios and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import scalars as S
from .registry import query


def _like(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _labels(text: str, phrases) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {_like(text, w)} THEN '{label}' END" for label, w in phrases) + "], lambda x: x IS NOT NULL))"


def _norm(c: str) -> str:
    return f"regexp_replace(regexp_replace(trim(lower({c})), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')"


def _count(text: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words) + ")"


def _stage(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {_like(text, w)} THEN '{s}'" for s, w in vocab.STAGE_PHRASES) + " END"


_INTENT = f"CASE WHEN {_count('t', vocab.NEGATIVE)} > {_count('t', vocab.POSITIVE)} THEN 'negative' WHEN {_count('t', vocab.POSITIVE)} > {_count('t', vocab.NEGATIVE)} THEN 'positive' ELSE 'neutral' END"


@query("b01_split_typed_id", "SELECT ord, CASE WHEN contains(object, ':') THEN substring(object, 1, position(':' in object) - 1) ELSE 'Unknown' END AS type, CASE WHEN contains(object, ':') THEN substring(object, position(':' in object) + 1) ELSE object END AS name FROM facts UNION ALL SELECT ord, CASE WHEN contains(object, ':') THEN substring(object, 1, position(':' in object) - 1) ELSE 'Unknown' END, CASE WHEN contains(object, ':') THEN substring(object, position(':' in object) + 1) ELSE object END FROM templated")
def b01(v):
    both = v("facts").select("ord", "object").unionByName(v("templated").select("ord", "object"))
    return both.select("ord", S.type_of("object").alias("type"), S.name_of("object").alias("name"))


@query("b02_split_endpoint", r"SELECT event_id, CASE WHEN regexp_matches(e, '^(GET|POST|PUT|DELETE|PATCH) (.*)$') THEN regexp_extract(e, '^(\w+) ', 1) ELSE 'UNKNOWN' END AS method, CASE WHEN regexp_matches(e, '^(GET|POST|PUT|DELETE|PATCH) (.*)$') THEN regexp_extract(e, '^\w+ (.*)$', 1) ELSE e END AS path FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'GET /u/' WHEN 'click' THEN 'POST /c/' WHEN 'error' THEN 'TRACE /e/' ELSE '/raw/' END || user_id AS e FROM events) x")
def b02(v):
    e = F.concat(F.when(F.col("event_type") == "view", "GET /u/").when(F.col("event_type") == "click", "POST /c/").when(F.col("event_type") == "error", "TRACE /e/").otherwise("/raw/"), F.col("user_id").cast("string"))
    return v("events").select("event_id", S.split_endpoint(e).alias("x")).select("event_id", "x.method", "x.path")


@query("b03_strip_quotes", """SELECT o_orderkey, trim('''"' || o_orderpriority || '"', '''"') AS text FROM orders""")
def b03(v):
    return v("orders").select("o_orderkey", S.strip_quotes(F.concat(F.lit("'\""), "o_orderpriority", F.lit('"'))).alias("text"))


@query("b04_tokens", r"SELECT ord, regexp_extract_all(object, '\$\{([^}]+)\}', 1) AS tokens FROM templated")
def b04(v):
    return v("templated").select("ord", S.tokens("object").alias("tokens"))


@query("b07_arn_name", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'a:b:' || c_name WHEN 2 THEN c_name ELSE 'arn:x:lambda:r:1:' END AS name FROM customer")
def b07(v):
    arn = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('arn:x:lambda:r:1:function:', c_name) WHEN 1 THEN concat('a:b:', c_name) WHEN 2 THEN c_name ELSE 'arn:x:lambda:r:1:' END")
    return v("customer").select("c_custkey", S.arn_name(arn).alias("name"))


@query("b08_canonical_id", "SELECT ord, ord % 5 NOT IN (1, 2, 3) AS canonical, CASE WHEN ord % 2 = 0 THEN 'Symbol:' || object ELSE 'Table:' || object END AS id FROM facts")
def b08(v):
    kind = F.when(F.col("ord") % 2 == 0, "Gadget").otherwise("Table")
    name = F.expr("CASE ord % 5 WHEN 1 THEN 'no colon' WHEN 2 THEN concat('Gadget:', object) WHEN 3 THEN 'Table:' ELSE object END")
    return v("facts").select("ord", S.is_canonical(name).alias("canonical"), S.canonical_id(kind, "object").alias("id"))


@query("b09_edge_id", "SELECT ord, left(sha256(subject || '|' || predicate || '|' || object), 16) AS edge_id FROM facts")
def b09(v):
    return v("facts").select("ord", S.edge_id("subject", "predicate", "object").alias("edge_id"))


@query("b10_content_hashes", "SELECT feature_file, left(sha256('2' || string_agg(h, '' ORDER BY h)), 32) AS fingerprint, count(*) AS n FROM (SELECT feature_file, left(sha256(trim(text)), 12) AS h FROM scenarios) x GROUP BY feature_file")
def b10(v):
    return v("scenarios").select("feature_file", S.text_hash("text").alias("h")).groupBy("feature_file").agg(S.fingerprint(F.col("h"), "2").alias("fingerprint"), F.count("*").alias("n"))


@query("b11_normalize", f"SELECT conv_id, pos, {_norm('text')} AS text FROM scenarios")
def b11(v):
    return v("scenarios").select("conv_id", "pos", S.normalize("text").alias("text"))


@query("b12_detect_actions", f"SELECT conv_id, pos, {_labels('t', vocab.ACTION_PHRASES)} AS actions FROM (SELECT conv_id, pos, {_norm('text')} AS t FROM scenarios) x")
def b12(v):
    return v("scenarios").select("conv_id", "pos", S.detect("text").alias("actions"))


@query("b13_intent", f"SELECT conv_id, pos, {_INTENT} AS intent FROM (SELECT conv_id, pos, {_norm('text')} AS t FROM scenarios) x")
def b13(v):
    return v("scenarios").select("conv_id", "pos", S.intent("text").alias("intent"))


@query("b14_stage", f"SELECT conv_id, pos, coalesce({_stage('f')}, {_stage('t')}, 'general') AS stage FROM (SELECT conv_id, pos, {_norm('feature_file')} AS f, {_norm('text')} AS t FROM scenarios) x")
def b14(v):
    return v("scenarios").select("conv_id", "pos", S.stage(["feature_file", "text"]).alias("stage"))


@query("b15_outcomes", f"SELECT conv_id, pos, CASE WHEN keyword IN ('Then', 'And', 'But') THEN list_sort(list_distinct(list_concat(a, CASE WHEN contains(t, 'should') OR contains(t, 'must') THEN list_transform(a, lambda x: 'expect_' || x) ELSE [] END, list_filter([CASE WHEN contains(t, 'not') AND contains(t, 'continue') THEN 'expect_stop' END, CASE WHEN contains(t, 'notified') OR contains(t, 'notify') THEN 'expect_notify' END], lambda x: x IS NOT NULL)))) ELSE [] END AS outcomes FROM (SELECT *, {_labels('t', vocab.ACTION_PHRASES)} AS a FROM (SELECT conv_id, pos, keyword, {_norm('text')} AS t FROM scenarios) x) y")
def b15(v):
    return v("scenarios").select("conv_id", "pos", S.outcomes("keyword", "text").alias("outcomes"))


@query("b17_overlap", r"SELECT a.p_partkey, CASE WHEN least(len(a.w), len(a.u)) > 0 THEN len(list_intersect(a.w, a.u)) / least(len(a.w), len(a.u)) ELSE 0.0 END AS score FROM (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) > 2)) AS w, list_distinct(list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda x: length(x) > 2)) AS u FROM part) a")
def b17(v):
    return v("part").select("p_partkey", S.overlap("p_name", "p_type").cast("double").alias("score"))


@query("b18_jaccard", "SELECT id, CASE WHEN len(list_distinct(list_concat(actions, outcomes))) = 0 THEN 1.0 ELSE len(list_intersect(actions, outcomes)) / len(list_distinct(list_concat(actions, outcomes))) END AS score FROM profiles")
def b18(v):
    return v("profiles").select("id", S.jaccard("actions", "outcomes").alias("score"))


@query("b19_section_key", r"SELECT p_partkey, trim(regexp_replace(trim(lower(p_partkey || '. ' || p_name)), '^[0-9.)\-: ]+', '')) AS key FROM part")
def b19(v):
    return v("part").select("p_partkey", S.section_key(F.concat(F.col("p_partkey").cast("string"), F.lit(". "), "p_name")).alias("key"))


_SECTION = "CASE p_partkey % 4 WHEN 0 THEN '6. User Stories' WHEN 1 THEN 'Gap Analysis' WHEN 2 THEN '1) System Overview' ELSE 'Appendix' END"


@query("b20_section_tier", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'primary' WHEN 2 THEN 'metadata' ELSE 'secondary' END AS tier FROM part")
def b20(v):
    return v("part").select("p_partkey", S.section_tier(F.expr(_SECTION)).alias("tier"))


@query("b21_handler_to_function", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'src.jobs.' || lower(c_mktsegment) WHEN 1 THEN 'win.' || lower(c_mktsegment) END AS function FROM customer")
def b21(v):
    handler = F.expr(r"CASE c_custkey % 3 WHEN 0 THEN concat('src/jobs/', lower(c_mktsegment), '.py.main') WHEN 1 THEN concat('win\\', lower(c_mktsegment), '.run') ELSE lower(c_mktsegment) END")
    return v("customer").select("c_custkey", S.handler_to_function(handler).alias("function"))


@query("b22_app_id", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'meta' || s_suppkey ELSE 'app' || s_suppkey END AS app_id FROM supplier")
def b22(v):
    k = F.col("s_suppkey").cast("string")
    return v("supplier").select("s_suppkey", S.app_id(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("meta"), k)).otherwise(F.lit(" ")), F.concat(F.lit("in/app"), k, F.lit("_quads.yaml"))).alias("app_id"))


@query("b23_item_id", r"SELECT p_partkey, left(p_brand || '::' || regexp_replace(p_name, '[^\w]+', '-', 'g') || '::REQ-' || p_size, 80) AS item_id FROM part")
def b23(v):
    return v("part").select("p_partkey", S.item_id("p_brand", "p_name", F.concat(F.lit("REQ-"), F.col("p_size").cast("string"))).alias("item_id"))


@query("b24_json_list", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [] WHEN 1 THEN [p_brand, p_type] ELSE [p_brand] END AS items, CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE NULL END AS a FROM part")
def b24(v):
    raw = F.when(F.col("p_partkey") % 3 == 1, F.to_json(F.array("p_brand", "p_type"))).when(F.col("p_partkey") % 3 == 2, F.col("p_brand"))
    obj = F.when(F.col("p_partkey") % 3 == 1, F.to_json(F.struct(F.col("p_brand").alias("a")))).when(F.col("p_partkey") % 3 == 2, F.lit("{broken"))
    return v("part").select("p_partkey", S.json_list(raw).alias("items"), S.json_map(obj)["a"].alias("a"))


@query("b25_provenance_note", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'requirement-backed: the document is the oracle' ELSE 'code-derived: the code is the oracle' END || CASE WHEN p_partkey % 2 = 0 THEN '; confirmed: overview' ELSE '' END AS note FROM part")
def b25(v):
    sections = F.create_map(F.lit("overview"), F.when(F.col("p_partkey") % 2 == 0, "human").otherwise("agent"), F.lit("stories"), F.lit("agent"))
    return v("part").select("p_partkey", S.provenance_note(F.col("p_size") % 2 == 0, sections).alias("note"))


@query("b26_grounding_descriptor", "SELECT subject, count(*) || ' facts; source ' || CASE WHEN max(line) IS NOT NULL THEN 'yes' ELSE 'no' END || '; ' || count(*) FILTER (NOT resolved) || ' of ' || count(*) || ' unresolved' AS descriptor FROM facts GROUP BY subject")
def b26(v):
    g = v("facts").groupBy("subject").agg(F.count("*").alias("n"), F.count_if(~F.col("resolved")).alias("open"), F.max("line").isNotNull().alias("source"))
    return g.select("subject", S.grounding_descriptor("n", "source", "open").alias("descriptor"))


@query("b27_backbone", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS backbone FROM customer")
def b27(v):
    text = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('kind=df:name=', c_name, ':mode=rw') WHEN 1 THEN concat('name= ', c_mktsegment, ' ') ELSE concat('title=', c_name) END")
    return v("customer").select("c_custkey", S.backbone(text).alias("backbone"))


@query("b28_bucket_of", "SELECT ord, CASE WHEN object LIKE 'S3Object:%' THEN split_part(substring(object, 10), '/', 1) END AS bucket FROM facts")
def b28(v):
    return v("facts").select("ord", S.bucket_of("object").alias("bucket"))


@query("b29_band", "SELECT event_id, CASE WHEN value >= 75 THEN 'Strong' WHEN value >= 50 THEN 'Partial' ELSE 'Low' END AS band FROM events")
def b29(v):
    return v("events").select("event_id", S.band("value").alias("band"))


@query("b32_note_text", "SELECT ord, coalesce(nullif(trim(CASE WHEN ord % 3 = 0 THEN '  ' ELSE extraction_method END), ''), subject || ' ' || predicate || ' ' || object) AS note FROM facts")
def b32(v):
    return v("facts").select("ord", S.note_text(F.when(F.col("ord") % 3 == 0, "  ").otherwise(F.col("extraction_method")), "subject", "predicate", "object").alias("note"))
