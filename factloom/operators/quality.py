"""Counts, duplicates and run-over-run reports over facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import scalars as S


def node_counts(facts: DataFrame) -> DataFrame:
    """Distinct nodes by type."""
    ends = facts.select(F.col("subject").alias("n")).union(facts.select("object")).distinct()
    return ends.groupBy(S.type_of("n").alias("type")).agg(F.count("*").alias("nodes"))


def edge_counts(facts: DataFrame) -> DataFrame:
    """Facts by predicate, most common first."""
    return facts.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate")


def row_counts(tables: dict[str, DataFrame], app: str) -> DataFrame:
    """E5: rows of an application by table; the archive (``facts``) must have some."""
    parts = [t.filter(F.col("app_id") == app).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("verdict", F.when((F.col("table_name") == "facts") & (F.col("n") == 0), "FAIL").otherwise("PASS"))


def duplicate_facts(facts: DataFrame) -> DataFrame:
    """Rows less distinct triples, by application; triples with a NULL count too."""
    return facts.groupBy("app_id", "subject", "predicate", "object").agg(F.count("*").alias("n")).groupBy("app_id").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def unresolved(facts: DataFrame) -> DataFrame:
    """Unresolved facts, facts with placeholders, distinct tokens, by application."""
    base = facts.groupBy("app_id").agg(F.count_if(~F.col("resolved")).alias("unresolved"), F.count_if(S.has_token("object")).alias("placeholders"))
    names = facts.select("app_id", F.explode(S.tokens("object")).alias("t")).distinct().groupBy("app_id").agg(F.count("*").alias("tokens"))
    return base.join(names.hint("merge"), "app_id", "left").select("app_id", "unresolved", "placeholders", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def snapshot(facts: DataFrame) -> DataFrame:
    """The measures of a run, one row an application."""
    p = F.col("predicate")
    return facts.groupBy("app_id").agg(
        F.count("*").alias("facts"), F.count_if("resolved").alias("resolved"), F.count_if(p.isin(*vocab.WRITES)).alias("writes"), F.count_if(p.isin(*vocab.READS)).alias("reads"),
        F.count_if(p.isin(*vocab.ENTRIES)).alias("entries"), F.count_if(p == "CALLS").alias("calls"), F.count_if(F.col("extraction_method") == "human").alias("human"), F.count_if(F.col("confidence").isNull()).alias("no_confidence"),
        F.count_if(F.col("line").isNull()).alias("no_line"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"), F.count_distinct("file_path").alias("files"),
    )


def run_measures(facts: DataFrame, entities: DataFrame, metadata: DataFrame) -> DataFrame:
    """The sixteen comparable numbers of a run, one row an application of ``metadata``.

    ``metadata(app_id, pending_names, unwired, handler_unlinked)`` has arrays and
    ``human_answers, decisions`` maps; NULL counts as none.
    """
    p, o = F.col("predicate"), F.col("object")
    distinct = lambda *preds: F.count_distinct(F.when(p.isin(*preds), o))
    of_facts = facts.groupBy("app_id").agg(
        F.count("*").alias("facts"), F.count_if(~F.coalesce("resolved", F.lit(True))).alias("unresolved_facts"), distinct("CALLS_HTTP_API").alias("web_calls"), distinct("READS_SECRET").alias("secrets"),
        distinct("READS_SSM_PARAMETER").alias("parameters"), distinct("QUERIES_DATABASE", "WRITES_DATABASE").alias("tables"), F.count_if(p == "HANDLED_BY").alias("lambda_links"),
    )
    blank = facts.select("app_id", F.explode(S.tokens("object")).alias("token")).distinct().groupBy("app_id").agg(F.count("*").alias("blank_names"))
    kinds = entities.groupBy("app_id").agg(F.count("*").alias("entities"), F.count_if(F.col("type") == "Journey").alias("journeys"), F.count_if(F.col("type") == "BehaviorGroup").alias("behavior_groups"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    own = {"questions_open": "pending_names", "human_answers": "human_answers", "decisions": "decisions", "unwired": "unwired", "lambdas_unlinked": "handler_unlinked"}
    out = metadata.select("app_id", *[size(F.when(F.col(c).isNotNull(), F.col(c))).alias(k) for k, c in own.items()])
    for df in (of_facts, blank, kinds):
        out = out.join(df.hint("merge"), "app_id", "left")
    return out.select("app_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in out.columns if c != "app_id"])


def capture_objects(facts: DataFrame, families: dict[str, Sequence[str]]) -> DataFrame:
    """(family, object, from_config, from_code, readable): each distinct object of a predicate family and where it was named."""
    family = F.lit(None).cast("string")
    for name, predicates in families.items():
        family = F.when(F.col("predicate").isin(*predicates), name).otherwise(family)
    config = F.startswith("subject", F.lit("ConfigFile:"))
    return facts.withColumn("family", family).filter("family IS NOT NULL").groupBy("family", "object").agg(F.bool_or(config).alias("from_config"), F.bool_or(~config).alias("from_code"), F.bool_or("resolved").alias("readable"))


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(app_id, measure, old, new) of the measures that changed."""
    names = [c for c in now.columns if c != "app_id"]
    long = lambda df, c: df.unpivot(["app_id"], names, "measure", c)
    return long(before, "old").join(long(now, "new"), ["app_id", "measure"], "full").filter(~F.col("old").eqNullSafe(F.col("new")))


def capture_inventory(facts: DataFrame, families: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Distinct objects by predicate family: how many, the first and the last."""
    families = families or {"writes": vocab.WRITES, "reads": vocab.READS, "entries": vocab.ENTRIES}
    family = F.lit(None).cast("string")
    for name, predicates in families.items():
        family = F.when(F.col("predicate").isin(*predicates), name).otherwise(family)
    return facts.withColumn("family", family).filter("family IS NOT NULL").select("family", "object").distinct().groupBy("family").agg(F.count("*").alias("n"), F.min("object").alias("first"), F.max("object").alias("last"), F.count_if(~S.has_token("object")).alias("readable"))


def reach(sizes: DataFrame, entries: DataFrame) -> DataFrame:
    """Starts, average reach, starts that reach nothing, of ``sizes(entry, members)``."""
    per = entries.select("entry").distinct().join(sizes.select("entry", F.col("members").alias("n")).hint("merge"), "entry", "left")
    return per.agg(F.count("*").alias("starts"), F.avg(F.coalesce("n", F.lit(0))).alias("average"), F.count_if(F.col("n").isNull()).alias("nothing"))


def doc_completeness(docs: DataFrame, required: Sequence[str] = vocab.SECTIONS) -> DataFrame:
    """Required sections that ``docs(unit, sections map)`` lacks or leaves blank."""
    want = F.array(*[S.section_key(F.lit(s)) for s in required])
    have = F.transform(F.map_keys(F.map_filter("sections", lambda _, v: F.trim(v) != "")), S.section_key)
    return docs.select("unit", F.sort_array(F.array_except(want, have)).alias("missing"))


def check_manifest(entries: DataFrame, docs: DataFrame, required: Sequence[str] = vocab.SECTIONS) -> DataFrame:
    """(unit, problem) of ``entries(unit, status, reason, doc_file)`` against ``docs(doc_file, sections map)``.

    A unit that isn't ``documented`` needs a reason; one that is needs a document, and that
    the required sections, not blank.
    """
    done, blank = F.col("status") == "documented", lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    have = F.transform(F.map_keys(F.map_filter("sections", lambda _, v: F.trim(v) != "")), S.section_key)
    keyed = [F.when(~F.array_contains(have, S.section_key(F.lit(s))), s) for s in required]
    known = docs.select("doc_file", F.array_compact(F.array(*keyed)).alias("missing"))
    rows = entries.join(known.hint("merge"), "doc_file", "left")
    problem = (
        F.when(~F.coalesce(done, F.lit(False)), F.when(blank("reason"), "no reason for the skip"))
        .when(blank("doc_file"), "no doc_file")
        .when(F.col("missing").isNull(), F.concat(F.lit("doc_file not found: "), "doc_file"))
        .when(F.size("missing") > 0, F.concat(F.lit("missing canonical sections: "), F.array_join("missing", ", ")))
    )
    return rows.select("unit", problem.alias("problem")).filter("problem IS NOT NULL")


def repo_map(entities: DataFrame, max_modules: int = 0) -> DataFrame:
    """(file_path, type, name), one row a unit; ``max_modules`` keeps the first modules by path with all of their units, 0 = all."""
    units = entities.select("file_path", "type", "name")
    if max_modules > 0:
        units = units.join(units.select("file_path").distinct().orderBy("file_path").limit(max_modules), "file_path", "left_semi")
    return units


def routing_stats(verified: DataFrame) -> DataFrame:
    """Facts by destination: verified, rejected, notes (not checkable)."""
    return verified.groupBy(F.when(F.col("verified"), "verified").when(~F.col("verified"), "rejected").otherwise("note").alias("destination")).agg(F.count("*").alias("n"))


def readiness(checks: DataFrame, pending: DataFrame) -> DataFrame:
    """WAIT if a check of the application fails or names are pending, else READY."""
    bad = checks.groupBy("app_id").agg(F.count_if(F.col("status") == "FAIL").alias("fails")).join(pending.groupBy("app_id").agg(F.count("*").alias("names")), "app_id", "left")
    return bad.select("app_id", "fails", F.coalesce("names", F.lit(0)).alias("pending"), F.when((F.col("fails") > 0) | (F.coalesce("names", F.lit(0)) > 0), "WAIT").otherwise("READY").alias("verdict"))


def typed_counts(counts: DataFrame, known: Sequence[str]) -> DataFrame:
    """Counts of known types, all others in one row."""
    return counts.groupBy(F.when(F.col("type").isin(*known), F.col("type")).otherwise("other").alias("type")).agg(F.sum("n").alias("n"))


def spec_status(journeys: DataFrame, specs: DataFrame) -> DataFrame:
    """D28"""
    return journeys.select("entry").join(specs.select(F.col("unit").alias("entry")).distinct().withColumn("s", F.lit(True)), "entry", "left").select("entry", F.when(F.col("s"), "covered").otherwise("missing").alias("status"))


def check_added(added: DataFrame, facts: DataFrame) -> DataFrame:
    """Added journeys whose start exists as a node."""
    nodes = facts.select(F.col("subject").alias("start")).union(facts.select("object")).distinct()
    return added.join(nodes, "start", "left_semi")
