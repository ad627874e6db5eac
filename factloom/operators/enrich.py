"""Enrichment joins over facts and entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import scalars as S
from ..sources.staged import sized, stage


def infer_components(entities: DataFrame, apps: DataFrame | None = None) -> DataFrame:
    """(app_id, component, languages, prefix, entity_count) by second path segment.

    Bare files and entities without one are ``_unassigned``, which has no prefix.  An
    application of ``apps(app_id)`` without entities has one component, ``default``.
    """
    part = F.split(F.coalesce("file_path", F.lit("")), "/")
    deep = F.size(part) >= 2
    rows = entities.withColumn("component", F.when(deep, F.get(part, F.lit(1))).otherwise("_unassigned")).withColumn("prefix", F.when(deep, F.concat_ws("/", F.get(part, F.lit(0)), F.get(part, F.lit(1)))).otherwise(""))
    out = rows.groupBy("app_id", "component").agg(F.sort_array(F.collect_set(F.nullif("language", F.lit("")))).alias("languages"), F.min_by("prefix", "id").alias("prefix"), F.count("*").alias("entity_count"))
    if apps is None:
        return out
    bare = apps.select("app_id").distinct().join(out.select("app_id"), "app_id", "left_anti")
    return out.unionByName(bare.select("app_id", F.lit("default").alias("component"), F.array().cast("array<string>").alias("languages"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("entity_count")))


def assign_components(entities: DataFrame, components: DataFrame) -> DataFrame:
    """The component of each entity, by its path; components go by name, those without a prefix last.

    The first whose prefix begins the path (a prefix has no closing slash, so ``src/app``
    also takes ``src/app2``), else the one named like the second segment, else the last.
    Without a path: the first named ``_unassigned`` or like the application, else the last.

    Prefixes are looked up by equality: each path offers its own beginnings of the
    lengths that its application has, so nothing is compared with everything, and each
    path is looked up once, however many entities it holds.
    """
    components = stage(components.select("app_id", "prefix", "component"), "components")
    place = F.struct(F.col("prefix") == "", "component")
    own = F.min_by(F.when(F.col("component").isin("_unassigned") | (F.col("component") == F.col("app_id")), F.col("component")), F.when(F.col("component").isin("_unassigned") | (F.col("component") == F.col("app_id")), place))
    apps = components.groupBy("app_id").agg(F.array_remove(F.collect_set(F.length("prefix")), 0).alias("ns"), F.max_by("component", place).alias("last"), own.alias("home"))
    path = F.coalesce("file_path", F.lit(""))
    paths = entities.select("app_id", path.alias("path")).distinct().join(sized(apps, "component-apps"), "app_id")
    begins = paths.select("app_id", "path", F.explode(F.transform("ns", lambda n: F.left(F.col("path"), n))).alias("prefix"))
    by_prefix = begins.join(sized(components.filter("prefix <> ''").groupBy("app_id", "prefix").agg(F.min("component").alias("component")), "component-prefixes"), ["app_id", "prefix"]).groupBy("app_id", "path").agg(F.min("component").alias("hit"))
    second = F.get(F.split("path", "/"), F.lit(1))
    named = sized(components.select("app_id", F.col("component").alias("second")).distinct(), "component-names")
    found = paths.withColumn("second", second).join(named.withColumn("named", F.col("second")), ["app_id", "second"], "left").join(by_prefix.hint("merge"), ["app_id", "path"], "left")
    found = found.select("app_id", F.col("path").alias("_path"), F.when(F.col("path") == "", F.coalesce("home", "last")).otherwise(F.coalesce("hit", "named", "last")).alias("component"))
    kept = [c for c in entities.columns if c != "component"]
    return entities.select(*kept, path.alias("_path")).join(found.hint("merge"), ["app_id", "_path"], "left").select(*kept, F.coalesce("component", F.lit("_unassigned")).alias("component"))


def bucket_edges(facts: DataFrame, buckets: DataFrame) -> DataFrame:
    """D3: distinct (subject, IN_BUCKET, object) from objects to the declared ``buckets(bucket)`` that hold them."""
    rows = facts.select(F.col("object").alias("subject"), S.bucket_of("object").alias("bucket")).filter("bucket IS NOT NULL").distinct()
    return rows.join(buckets.select("bucket").distinct(), "bucket", "left_semi").select("subject", F.lit("IN_BUCKET").alias("predicate"), F.concat(F.lit("S3Object:"), "bucket").alias("object"))


def link_handlers(handlers: DataFrame, functions: DataFrame, hints: DataFrame) -> DataFrame:
    """``handlers(lambda, handler)`` to the one function it names.

    The handler is a function name (confidence 1) or a dotted suffix of exactly one; of
    several, the one whose own parts (those not shared by all candidates) occur in a hint
    (0.9).  Others stay unlinked, with their candidates.
    """
    f = functions.select("name").distinct()
    parts = F.split("name", r"\.")
    suffix = f.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))).alias("handler"))
    hits = handlers.join(suffix.hint("merge"), "handler")
    exact = hits.filter("handler = name").select("lambda", F.lit(True).alias("exact")).distinct()
    rows = hits.join(exact.hint("merge"), "lambda", "left").filter("exact IS NULL OR handler = name")
    per = Window.partitionBy("lambda")
    rows = rows.withColumn("n", F.count("*").over(per))
    words = rows.select("lambda", "name", "n", F.explode(F.array_distinct(F.split("name", r"\."))).alias("part"))
    own = words.withColumn("shared", F.count("*").over(Window.partitionBy("lambda", "part"))).filter("shared < n")
    hinted = own.join(hints.hint("merge"), "lambda").filter(F.contains(F.col("hint"), F.col("part"))).select("lambda", "name").distinct()
    hinted = hinted.withColumn("h", F.count("*").over(per)).filter("h = 1").select("lambda", F.col("name").alias("pick"))
    got = rows.groupBy("lambda").agg(F.first("n").alias("n"), F.min("name").alias("only"), F.sort_array(F.collect_set("name")).alias("candidates"))
    out = handlers.join(got.hint("merge"), "lambda", "left").join(hinted.hint("merge"), "lambda", "left")
    return out.select("lambda", "handler", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("pick")).alias("function"), F.when(F.col("n") == 1, 1.0).when(F.col("pick").isNotNull(), 0.9).alias("confidence"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def implementation_edges(facts: DataFrame) -> DataFrame:
    """Interface method to implementing method, by IMPLEMENTS and equal method names."""
    method = lambda c: F.element_at(F.split(c, r"\."), -1)
    defines = facts.filter("predicate = 'DEFINES'").select(F.col("subject").alias("owner"), F.col("object").alias("method"), method("object").alias("m"))
    impl = facts.filter("predicate = 'IMPLEMENTS' AND resolved").select(F.col("subject").alias("cls"), F.col("object").alias("iface"))
    a = defines.select(F.col("owner").alias("iface"), F.col("method").alias("subject"), "m")
    b = defines.select(F.col("owner").alias("cls"), F.col("method").alias("object"), "m")
    return impl.join(a, "iface").join(b, ["cls", "m"]).select("subject", F.lit("IMPLEMENTED_BY").alias("predicate"), "object").distinct()


def config_sql_facts(config_sql: DataFrame, literals: DataFrame) -> DataFrame:
    """``config_sql(key, file, table, is_write)`` meets ``literals(function, value)`` by key.

    A key's distinct facts meet the distinct functions that name it, so repeated rows don't multiply.
    """
    write = F.when(F.col("is_write"), "WRITES_DATABASE").otherwise("QUERIES_DATABASE")
    said = config_sql.select("key", write.alias("predicate"), F.concat(F.lit("Table:"), "table").alias("object")).unionByName(config_sql.select("key", F.lit("READS_FILE").alias("predicate"), F.col("file").alias("object"))).distinct()
    rows = literals.select(F.col("function").alias("subject"), F.col("value").alias("key")).distinct().join(sized(said, "config-facts"), "key")
    return rows.select("subject", "predicate", "object").distinct()


def competing_files(settings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Files of ``settings(file, key, value)`` that disagree on a key and aren't chosen; they go whole."""
    spread = settings.groupBy("key").agg(F.count_distinct("value").alias("values"), F.count_distinct("file").alias("files")).filter("values > 1 AND files > 1")
    return settings.join(spread, "key", "left_semi").select("file").distinct().join(chosen.select("file"), "file", "left_anti")


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Bare callee to the one function of that last segment (1.0), several to ``Symbol:`` (0.5), none to no edge."""
    last = functions.groupBy(F.element_at(F.split("name", r"\."), -1).alias("callee")).agg(F.count_distinct("name").alias("n"), F.min("name").alias("name"))
    return calls.join(last, "callee").select("caller", "callee", F.when(F.col("n") == 1, F.concat(F.lit("Function:"), "name")).otherwise(F.concat(F.lit("Symbol:"), "callee")).alias("target"), F.when(F.col("n") == 1, 1.0).otherwise(0.5).alias("confidence"))


def step_lineage(steps: DataFrame) -> DataFrame:
    """Each consumer of a dataframe to its latest earlier producer in the file, as-of by step order.

    ``steps(file, pos, step, role, df)`` with role ``out`` or ``in``; one window, one shuffle.
    """
    w = Window.partitionBy("file", "df").orderBy("pos", "role").rowsBetween(Window.unboundedPreceding, -1)  # a step reads before it makes
    made = F.last(F.when(F.col("role") == "out", F.col("step")), ignorenulls=True).over(w)
    rows = steps.withColumn("producer", made).filter("role = 'in'")
    source = F.coalesce("producer", F.concat(F.lit("Dataframe:"), "df"))
    return rows.select(source.alias("source"), "step", "file", F.when(F.col("producer").isNotNull(), 1.0).otherwise(0.5).alias("confidence")).dropDuplicates(["file", "step", "source"])


def topology_edges(flows: DataFrame, kinds: DataFrame) -> DataFrame:
    """``flows(kind, src, dst)`` with both prefixes from ``kinds``; kinds without a mapping drop out."""
    return flows.join(kinds, "kind").select(F.concat_ws(":", "src_kind", "src").alias("src"), F.concat_ws(":", "dst_kind", "dst").alias("dst"), "kind").distinct()


def enrich_nodes(nodes: DataFrame, roster: DataFrame) -> DataFrame:
    """Tier and kind from the roster, else L1 and core."""
    return nodes.join(roster, "id", "left").select(nodes["id"], F.coalesce("tier", F.lit("L1")).alias("tier"), F.coalesce("kind", F.lit("core")).alias("kind"))


#: Attributes that stand for the name of a resource of the type (the provider's published schema), and the argument that holds it.
IDENTITY = {"aws_lambda_function": (("arn", "id", "function_name", "qualified_arn", "invoke_arn"), "function_name"), "aws_sfn_state_machine": (("arn", "id", "name"), "name")}


def resolve_refs(config_rows: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, value) of ``refs(ref)`` from the leaves of ``config_rows(ord, kind, path array, value, is_literal)``.

    ``var.a["b"].c`` chooses its root once: the values file's ``a`` if there is one, be it a
    literal or not, else the variable's literal default; from there each hop must be there.
    ``local.a`` and ``type.label.attribute`` have no further hops; ``IDENTITY`` attributes
    read the argument that names the resource.  What isn't stated as a literal is NULL.
    Kinds are values, variable, local and resource (path: type, label, attribute); of rows
    of one root those of the largest ``ord`` count, of variables and locals only literals.
    """
    root = F.when(F.col("kind") == "resource", F.slice("path", 1, 2)).otherwise(F.slice("path", 1, 1))
    rows = config_rows.filter(~F.col("kind").isin("variable", "local") | F.col("is_literal")).withColumn("root", root)
    last = rows.groupBy("kind", "root").agg(F.max("ord").alias("ord"))
    leaves = rows.join(last.hint("merge"), ["kind", "root", "ord"], "left_semi").filter("is_literal").groupBy("kind", "path").agg(F.min("value").alias("value"))
    given = last.filter("kind = 'values'").select("root", F.lit(True).alias("given"))
    parts = F.transform(F.regexp_extract_all("ref", F.lit(r'\["[^"]*"\]|[^.\[\]]+'), F.lit(0)), lambda x: F.regexp_replace(x, r'^\["|"\]$', ""))
    asked = refs.select("ref").distinct().withColumn("p", parts)
    first, n = F.get("p", F.lit(0)), F.size("p")
    attr, rtype = F.get("p", F.lit(2)), first
    for kind, (attrs, holder) in IDENTITY.items():
        attr = F.when((rtype == kind) & F.get("p", F.lit(2)).isin(*attrs), holder).otherwise(attr)
    rest = F.slice("p", F.lit(2), F.greatest(n - 1, F.lit(0)))
    asked = asked.withColumn("root", F.when((first == "var") & (n >= 2), F.slice("p", 2, 1)))
    asked = asked.join(given.hint("merge"), "root", "left")
    kind = F.when(F.col("root").isNotNull(), F.when(F.col("given"), "values").otherwise("variable")).when((first == "local") & (n == 2), "local").when(n == 3, "resource")
    asked = asked.select("ref", kind.alias("kind"), F.when(kind == "resource", F.array(first, F.get("p", F.lit(1)), attr)).otherwise(rest).alias("path"))
    found = asked.join(leaves.hint("merge"), ["kind", "path"]).select("ref", "value")
    return refs.join(found.hint("merge"), "ref", "left").select("ref", "value")


def merge_declarations(declarations: DataFrame) -> DataFrame:
    """(name, handler, hints, settings) of ``declarations(ord, name, handler, hint, settings)``.

    The first declaration of a name wins; hints of all stay, distinct and in order, and so do
    settings (a map), of which the first of each key counts.
    """
    per = declarations.groupBy("name").agg(F.min_by("handler", "ord").alias("handler"), F.sort_array(F.collect_list(F.struct("ord", "hint"))).alias("all"))
    keys = declarations.select("name", "ord", F.explode("settings").alias("key", "value")).groupBy("name", "key").agg(F.min_by("value", "ord").alias("value"))
    keys = keys.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("settings"))
    out = per.join(keys.hint("merge"), "name", "left")
    return out.select("name", "handler", F.array_distinct(F.transform("all", lambda x: x["hint"])).alias("hints"), F.coalesce("settings", F.create_map().cast("map<string,string>")).alias("settings"))


def canonical_order(facts: DataFrame) -> DataFrame:
    """F9"""
    return facts.orderBy("file_path", F.coalesce("line", F.lit(0)), "predicate", "object", "subject")


def verify_facts(claims: DataFrame, lines: DataFrame, window: int = 3) -> DataFrame:
    """Whether the name of each claim occurs in lines [line - 3, line + 3] of its file; NULL without a line.

    The window is spread over the claims, so the range join is an equi join on (file, line).
    """
    wide = claims.filter("line IS NOT NULL").withColumn("pos", F.explode(F.sequence(F.col("line") - window, F.col("line") + window)))
    hit = wide.join(lines.hint("merge"), ["file", "pos"]).groupBy("id").agg(F.max(F.contains(F.lower("text"), F.lower("name"))).alias("found"))
    return claims.join(hit.hint("merge"), "id", "left").select("id", F.when(F.col("line").isNotNull(), F.coalesce("found", F.lit(False))).alias("verified"))


def check_facts(facts: DataFrame, lines: DataFrame, around: int = 3, types: Sequence[str] = vocab.TYPES) -> DataFrame:
    """(id, verified, reason) of ``facts(id, subject, predicate, object, file, line)`` against ``lines(file, pos, text)``, ``pos`` from 0.

    What a predicate calls for must be in the lines up to ``around`` before and after the
    fact's line (the first without one).  False if the file isn't there; NULL without a file,
    or where an unknown predicate's object leaves nothing to look for.
    """
    at = F.coalesce("line", F.lit(1)) - 1
    spread = facts.filter("file IS NOT NULL").select("id", "file", F.explode(F.sequence(F.greatest(at - around, F.lit(0)), F.greatest(at + around, F.lit(0)))).alias("pos"))
    near = spread.join(lines.hint("merge"), ["file", "pos"]).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("win"))
    there = lines.select("file").distinct().withColumn("there", F.lit(True))
    rows = facts.join(near.hint("merge"), "id", "left").join(there.hint("merge"), "file", "left").withColumn("win", F.coalesce("win", F.lit("")))
    win, p = F.col("win"), F.col("predicate")
    has = lambda *words: F.greatest(F.lit(False), *[F.contains(win, w if not isinstance(w, str) else F.lit(w)) for w in words])
    obj = F.trim(F.split(F.col("object"), r" \(", 2)[0])
    obj = F.when(F.instr(obj, ":").cast("boolean") & F.substring_index(obj, ":", 1).isin(*types), S.name_of(obj)).otherwise(obj)
    last = lambda c, *seps: last(F.element_at(F.split(c, seps[0]), -1), *seps[1:]) if seps else c
    path = F.when(F.instr(obj, " ") > 0, F.substr(obj, F.instr(obj, " ") + 1)).otherwise(obj)
    parts = F.filter(F.split(path, "/"), lambda s: (F.length(s) > 2) & ~F.contains(s, F.lit("<")) & ~F.contains(s, F.lit("{")))
    tail = F.when(F.size(parts) > 0, F.element_at(parts, F.when(F.size(parts) > 0, -1).otherwise(1))).otherwise(path)
    table = F.regexp_replace(last(obj, r"\."), r"^[${}]+|[${}]+$", "")
    token = F.regexp_replace(last(obj, "::", r"\.", " "), r"^[${}/]+|[${}/]+$", "")
    sql = F.upper(win).rlike("INSERT|SELECT|UPDATE|DELETE FROM")
    rule = (
        F.when(p == "EXPOSES_ENDPOINT", F.contains(win, path) | (F.contains(win, tail) & (F.contains(F.lower(win), F.lit("route")) | has("@"))))
        .when(p.isin("CALLS", "DEFINES"), F.contains(win, last(obj, "::", r"\.")))
        .when(p.isin("QUERIES_DATABASE", "WRITES_DATABASE"), has(table, "session", ".query(", ".add(", ".filter", "execute", "__tablename__") | sql)
        .when(p.isin("READS_FROM_S3", "WRITES_TO_S3"), has("get_object", "put_object", "upload", "download", "s3", "S3", "boto3"))
        .when(p == "READS_ENV_VAR", F.contains(win, obj) & has("environ", "getenv"))
        .when(p == "INVOKES_LAMBDA", has("invoke", last(obj, r"\.")))
        .when(p == "FEEDS", has(last(F.col("subject"), "::"), last(obj, "::")))
        .otherwise(F.when(token != "", F.contains(win, token)))
    )
    # What was looked for, by predicate.
    sought = (
        F.when(p == "EXPOSES_ENDPOINT", F.when(F.contains(win, path), "endpoint path present").otherwise("endpoint (blueprint suffix)"))
        .when(p == "CALLS", "callee name present")
        .when(p == "DEFINES", "definition present")
        .when(p.isin("QUERIES_DATABASE", "WRITES_DATABASE"), "table/sql/ORM present")
        .when(p.isin("READS_FROM_S3", "WRITES_TO_S3"), "s3 op present")
        .when(p == "READS_ENV_VAR", "env read present")
        .when(p == "INVOKES_LAMBDA", "lambda invoke present")
        .when(p == "FEEDS", "lineage endpoint present")
        .otherwise("generic token present")
    )
    reason = F.when(F.col("file").isNull(), "no file:line on fact").when(F.col("there").isNull(), F.concat(F.lit("file not found: "), F.col("file").cast("string"))).otherwise(sought)
    return rows.select("id", F.when(F.col("file").isNotNull(), F.when(F.col("there").isNull(), False).otherwise(rule)).alias("verified"), reason.alias("reason"))


def grade(verified: DataFrame) -> DataFrame:
    """Kept, rejected, uncheckable and the precision in percent to one place, 0 if nothing could be checked."""
    kept, no = F.count_if("verified"), F.count_if(~F.col("verified"))
    return verified.agg(kept.alias("kept"), no.alias("rejected"), F.count_if(F.col("verified").isNull()).alias("uncheckable"), F.when(kept + no > 0, F.round(100.0 * kept / (kept + no), 1)).otherwise(0.0).alias("precision"))


def rejects(verified: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rejected claims by id, with all their columns, such as the ``reason`` that ``check_facts`` gives."""
    return verified.filter(~F.col("verified")).orderBy("id").limit(n)


def stranded(facts: DataFrame, preds: Sequence[str] = (*vocab.WRITES, *vocab.READS)) -> DataFrame:
    """Resources read or written under a name that is still open."""
    return facts.filter(F.col("predicate").isin(*preds) & F.contains("object", F.lit("${"))).select("object").distinct()


def handoffs(facts: DataFrame, writes: Sequence[str] = vocab.WRITES, reads: Sequence[str] = vocab.READS) -> DataFrame:
    """Resources both written and read."""
    w = facts.filter(F.col("predicate").isin(*writes)).select("object")
    return w.intersect(facts.filter(F.col("predicate").isin(*reads)).select("object"))
