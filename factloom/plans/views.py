"""Views that turn the driver's tables into facts, scenarios, profiles and runs.

The text of a view is SQL that Spark and DuckDB both run, so a query and its oracle start
from the same rows.  Spark derives each view on the cluster; nothing is collected.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_EDGES = """
SELECT CAST(1000000000000 AS BIGINT) + n_nationkey AS ord, 'core' AS app_id, concat('Function:nation.', n_name) AS subject, 'EXPOSES_ENDPOINT' AS predicate, concat('APIEndpoint:region.', r_name) AS object, CAST(n_nationkey AS BIGINT) AS k FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 2000000000000 + c_custkey, 'core', concat('Function:nation.', n_name), 'CALLS', concat('Method:cust.', CAST(c_custkey AS VARCHAR(20))), c_custkey FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT 3000000000000 + o_orderkey, 'core', concat('Method:cust.', CAST(o_custkey AS VARCHAR(20))), 'CALLS', concat('Step:ord.', CAST(o_orderkey AS VARCHAR(20))), o_orderkey FROM {orders}
UNION ALL SELECT 4000000000000 + l_orderkey * 10 + l_linenumber, 'core', concat('Step:ord.', CAST(l_orderkey AS VARCHAR(20))), 'WRITES_DATABASE', concat('Table:part.', CAST(l_partkey AS VARCHAR(20))), l_partkey FROM {lineitem}
UNION ALL SELECT DISTINCT 5000000000000 + l_partkey * 100000 + l_suppkey, 'core', concat('Function:supp.', CAST(l_suppkey AS VARCHAR(20))), 'QUERIES_DATABASE', concat('Table:part.', CAST(l_partkey AS VARCHAR(20))), l_partkey FROM {lineitem}
UNION ALL SELECT 6000000000000 + s_suppkey, 'core', concat('Module:nation.', n_name), 'DEFINES', concat('Function:supp.', CAST(s_suppkey AS VARCHAR(20))), s_suppkey FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 7000000000000 + user_id * 1000 + ascii(event_type), 'events', concat('Function:user.u', CAST(user_id AS VARCHAR(20))), 'WRITES_TO_S3', concat('S3Object:', event_type, '/', CAST(user_id AS VARCHAR(20))), user_id FROM {events}
UNION ALL SELECT 8000000000000 + o_orderkey, 'core', concat('Function:regional.', r_name), 'CALLS', concat('Step:ord.', CAST(o_orderkey AS VARCHAR(20))), o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 9000000000000 + o_orderkey, 'core', concat('Function:audit.', o_orderpriority), 'CALLS', concat('Step:ord.', CAST(o_orderkey AS VARCHAR(20))), o_orderkey FROM {orders}
"""

VIEWS: dict[str, str] = {
    "facts": f"""SELECT ord, app_id, subject, predicate, object, k % 7 <> 0 AS resolved, CAST(CASE WHEN k % 13 = 0 THEN NULL ELSE 0.5 + (k % 5) / 10.0 END AS DOUBLE) AS confidence,
        concat(app_id, '/', lower(substring(subject, 1, 6)), '/f', CAST(k % 50 AS VARCHAR(20)), '.py') AS file_path,
        CASE WHEN k % 11 = 0 THEN NULL ELSE k % 500 END AS line, CASE WHEN k % 17 = 0 THEN 'human' ELSE 'ast' END AS extraction_method FROM ({_EDGES}) e""",
    "entities": """SELECT app_id, id, substring(id, 1, position(':' in id) - 1) AS type, substring(id, position(':' in id) + 1) AS name,
        concat(app_id, '/', lower(substring(id, 1, position(':' in id) - 1)), '/', substring(id, position(':' in id) + 1), '.py') AS file_path,
        CASE WHEN length(id) % 2 = 0 THEN 'python' ELSE 'java' END AS language
        FROM (SELECT DISTINCT app_id, subject AS id FROM {facts} UNION SELECT DISTINCT app_id, object FROM {facts}) e
        WHERE id LIKE 'Function:%' OR id LIKE 'Method:%' OR id LIKE 'Step:%'""",
    "templated": """SELECT o_orderkey AS ord, concat('app', CAST(o_orderkey % 3 AS VARCHAR(20))) AS app_id, concat('Function:w.', CAST(o_custkey AS VARCHAR(20))) AS subject, 'WRITES_TO_S3' AS predicate,
        concat('s3://$', '{{', o_orderstatus, '}}/$', '{{', o_orderpriority, '}}', CASE WHEN o_orderkey % 10 = 0 THEN '/$' ELSE '' END, CASE WHEN o_orderkey % 10 = 0 THEN '{{}}' ELSE '' END) AS object,
        o_orderkey % 7 = 0 AS symbolic, FALSE AS resolved, CAST(0.5 AS DOUBLE) AS confidence FROM {orders}
        UNION ALL SELECT 100000000000 + o_orderkey, 'app0', concat('Function:p.', CAST(o_custkey AS VARCHAR(20))), 'READS_FILE', concat('plain/', o_orderstatus), FALSE, FALSE, CAST(0.5 AS DOUBLE) FROM {orders} WHERE o_orderkey % 50 = 1""",
    "bindings": """SELECT DISTINCT o_orderstatus AS token, concat('repo-', lower(o_orderstatus)) AS value, 2 AS layer FROM {orders} WHERE o_orderstatus <> 'P'
        UNION ALL SELECT DISTINCT o_orderpriority, concat('pri', substring(o_orderpriority, 1, 1)), 2 FROM {orders} WHERE o_orderpriority < '4'
        UNION ALL SELECT DISTINCT o_orderstatus, 'human-f', 1 FROM {orders} WHERE o_orderstatus = 'F'""",
    "scenarios": """SELECT concat('conv', CAST(conv_id % 20 AS VARCHAR(20)), '.feature') AS feature_file, concat('Feature ', CAST(conv_id % 20 AS VARCHAR(20))) AS feature_name, concat('conversation ', CAST(conv_id AS VARCHAR(20))) AS name, conv_id, turn AS pos,
        CASE role WHEN 'system' THEN 'Given' WHEN 'user' THEN 'When' ELSE 'Then' END AS keyword,
        concat(CASE conv_id % 5 WHEN 0 THEN 'the import should validate ' WHEN 1 THEN 'a failure must stop and not continue ' WHEN 2 THEN 'notify stakeholder of success ' WHEN 3 THEN 'Retrieve source_data, retry on timeout ' ELSE '' END, text) AS text FROM {conversations}""",
    "doc_lines": """SELECT doc_id, pos, line FROM {lines}""",
    "runs": """SELECT event_id, user_id AS bundle, event_type, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS gate,
        CASE WHEN value > 90 THEN 'FAIL' WHEN value < 5 THEN 'SKIP' ELSE 'PASS' END AS status, value, ts FROM {events}""",
    "feedback": """SELECT event_id AS id, concat('app', CAST(user_id % 4 AS VARCHAR(20))) AS app_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('unit', CAST(user_id % 10 AS VARCHAR(20))) END AS unit,
        CASE WHEN event_type = 'click' THEN 'spec' WHEN event_type = 'signup' THEN 'other' ELSE 'test' END AS artifact, CASE event_type WHEN 'view' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'comment' END AS action,
        CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('please fix ', event_type) END AS comment, CASE WHEN event_id % 3 = 0 THEN 'open' WHEN event_id % 3 = 1 THEN 'applied' ELSE 'closed' END AS status, ts AS created_at FROM {events}""",
    "shop_facts": """SELECT o_custkey % 40 AS shop, concat('shop', CAST(o_custkey % 40 AS VARCHAR(20))) AS app_id, CAST(o_orderkey AS BIGINT) AS ord, concat('Method:cust.', CAST(o_custkey AS VARCHAR(20))) AS subject,
        CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'CALLS' END AS predicate, concat('Step:ord.', CAST(o_orderkey AS VARCHAR(20)), CASE WHEN o_orderkey % 5 = 0 THEN ': "x" # y' ELSE '' END) AS object, 'python' AS language,
        concat('f', CAST(o_orderkey % 9 AS VARCHAR(20)), '.py') AS file_path, CAST(o_orderkey % 500 AS INT) AS line, 'ast' AS extraction_method, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 8) / 8.0 END AS DOUBLE) AS confidence, o_orderkey % 7 <> 0 AS resolved FROM {orders}""",
    "requirement_files": """SELECT s_suppkey AS n, concat('unit', CAST(s_suppkey AS VARCHAR(20))) AS name, CASE WHEN s_suppkey % 10 = 3 THEN '{{"unit": ' WHEN s_suppkey % 10 = 5 THEN '{{"title": "no unit"}}' ELSE
        concat('{{"confidence": ', CASE WHEN s_suppkey % 4 = 0 THEN 'null' ELSE '0.5' END, ', "feedback_ids": [', CAST(s_suppkey AS VARCHAR(20)), '], "requirement_backed": ', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END,
        ', "sections": {{"Business Rules": "rule ', chr(92), '"', CAST(s_suppkey AS VARCHAR(20)), chr(92), '"", "Notes": ""}}, "title": "', s_name, '", "unit": "unit', CAST(s_suppkey AS VARCHAR(20)), '"}}') END AS line FROM {supplier}""",
    "profiles": """SELECT CASE c_nationkey % 2 WHEN 0 THEN 'ref' ELSE 'cand' END AS side, concat('suite', CAST(c_nationkey % 5 AS VARCHAR(20))) AS app_id, c_custkey AS id, concat('scenario ', CAST(c_custkey AS VARCHAR(20))) AS name, concat('f', CAST(c_custkey % 6 AS VARCHAR(20)), '.feature') AS feature_file,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'general' WHEN 'BUILDING' THEN 'transform' WHEN 'FURNITURE' THEN 'extract' WHEN 'HOUSEHOLD' THEN 'load' ELSE 'validate' END AS stage,
        CASE WHEN c_acctbal < 1000 THEN 'negative' WHEN c_acctbal > 5000 THEN 'positive' ELSE 'neutral' END AS intent, actions, outcomes FROM {customer} JOIN
        (SELECT o_custkey, sort_array(collect_set(concat('a', substring(o_orderpriority, 1, 1)))) AS actions, sort_array(collect_set(o_orderstatus)) AS outcomes FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_LINES_SQL = "(SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or table by name, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name == "lines":
        return table(spark, sf_dir, "documents").selectExpr("doc_id", "posexplode(split(text, '\n')) AS (pos, line)")
    text = VIEWS[name].replace("{{", "\0").replace("}}", "\1")
    needs = dict.fromkeys(re.findall(r"{(\w+)}", text))
    frames = {f"_{n}": view(spark, sf_dir, n) for n in needs}
    for n in needs:
        text = text.replace(f"{{{n}}}", f"{{_{n}}}")
    text = text.replace("VARCHAR(20)", "STRING").replace("\0", "{{").replace("\1", "}}")
    return spark.sql(text, **frames)


def with_views(sql: str) -> str:
    """The same for DuckDB: views as common table expressions before ``sql``, which may begin with WITH."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed or name in TABLES or name == "lines":
            return
        for n in re.findall(r"{(\w+)}", VIEWS[name].replace("{{", "").replace("}}", "")):
            add(n)
        needed.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    parts = []
    for n in needed:
        text = VIEWS[n].replace("{{", "\0").replace("}}", "\1")
        text = re.sub(r"{(\w+)}", lambda m: _LINES_SQL if m[1] == "lines" else m[1], text).replace("\0", "{").replace("\1", "}")
        text = re.sub(r"sort_array\(collect_set\((.+?)\)\) AS", r"list_sort(list(DISTINCT \1)) AS", text)
        parts.append(f"{n} AS MATERIALIZED ({text})")
    if not parts:
        return sql
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"(?i)with\s+recursive\b", body) else ""
    if re.match(r"(?i)with\b", body):
        body = re.sub(r"(?i)^with(\s+recursive)?\s+", "", body)
        return f"WITH {recursive}{', '.join(parts)}, {body}"
    return f"WITH {', '.join(parts)} {body}"
