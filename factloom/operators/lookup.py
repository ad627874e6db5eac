"""Name lookup, grounding and coverage gates: equi joins first, pattern joins only for what they miss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import scalars as S
from ..sources.staged import sized, stage
from .graph import latest


def route_facts(facts: DataFrame, routes: Sequence[tuple] = vocab.ROUTES) -> DataFrame:
    """Facts with the table and kind that their predicate is routed to; others drop out."""
    table, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for predicate, t, k in routes:
        table = F.when(F.col("predicate") == predicate, t).otherwise(table)
        kind = F.when(F.col("predicate") == predicate, k).otherwise(kind)
    return facts.filter(F.col("predicate").isin(*[r[0] for r in routes])).withColumns({"table_name": table, "kind": kind})


def kb_names(facts: DataFrame) -> DataFrame:
    """(app_id, table_name, ord, name, resolved, confidence): the routed names, first fact of each wins."""
    routed = route_facts(facts).select("app_id", "table_name", "ord", S.name_of("object").alias("name"), "resolved", "confidence")
    return routed.groupBy("app_id", "table_name", "name").agg(F.min("ord").alias("ord"), F.min_by("resolved", "ord").alias("resolved"), F.min_by("confidence", "ord").alias("confidence"))


_GRAMS = """CASE WHEN {n} = 0 THEN array('') ELSE array_distinct(flatten(transform(filter({runs}, x -> length(x) >= {n}), x -> transform(sequence(1, length(x) - {n} + 1), i -> substring(x, i, {n}))))) END"""


def _containing(missed: DataFrame, kb: DataFrame) -> DataFrame:
    """``missed`` with the names of the application that contain q.

    A q meets the names by one of its literal grams, the one that the fewest names have; it
    has three letters, or as many as the longest run between wildcards, or none.
    """
    runs = missed.withColumn("_runs", F.split(F.lower("q"), r"[%_\\]")).withColumn("_n", F.expr("least(3, array_max(transform(_runs, x -> length(x))))"))
    asked = runs.select("app_id", "q", F.explode(F.expr(_GRAMS.format(n="_n", runs="_runs"))).alias("gram"))
    sizes = F.explode(F.expr("filter(array(0, 1, 2, 3), n -> n <= length(name))"))
    names = kb.select("app_id", "table_name", "name", "resolved", "confidence", sizes.alias("_n")).withColumn("gram", F.explode(F.expr(_GRAMS.format(n="_n", runs="array(lower(name))"))))
    names = names.drop("_n").join(sized(asked.select("app_id", "gram").distinct(), "names-grams"), ["app_id", "gram"], "left_semi")
    held = names.groupBy("app_id", "gram").agg(F.count("*").alias("_held"))
    rare = asked.join(held.hint("shuffle_hash"), ["app_id", "gram"], "left").groupBy("app_id", "q").agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("held"), "gram")).alias("_r"))
    rare = rare.filter("_r.held > 0").select("app_id", "q", F.col("_r.gram").alias("gram"))
    return names.join(sized(rare, "names-rare"), ["app_id", "gram"]).filter(F.expr("lower(name) LIKE concat('%', lower(q), '%')"))


def resolve_names(queries: DataFrame, kb: DataFrame, limit: int = 5, tables: Sequence[str] | None = None) -> DataFrame:
    """Candidates for ``queries(app_id, q)``: exact names; else q itself as a bucket that holds stored
    paths; else names that contain q in any case (``%`` and ``_`` in q are wildcards).

    ``tables`` restricts the kinds asked for.  Repeated queries count once; ``limit`` holds for each query, by
    table and name.  Missing confidence is 1.0 for an exact hit and 0.5 for others; missing resolved is true.
    """
    out = lambda df, how, c: df.select("app_id", "q", "table_name", "name", F.lit(how).alias("how"), F.coalesce("resolved", F.lit(True)).alias("resolved"), F.coalesce("confidence", F.lit(c)).alias("confidence"))
    queries = stage(queries.select("app_id", "q").distinct(), "names-asked")
    kb = stage(kb if tables is None else kb.filter(F.col("table_name").isin(*tables)), "names-known")
    left = lambda df, found: df.join(found.select("app_id", "q").distinct(), ["app_id", "q"], "left_anti")
    exact = out(queries.join(kb, (queries["q"] == kb["name"]) & (queries["app_id"] == kb["app_id"])).drop(kb["app_id"]), "exact", 1.0)
    missed = stage(left(queries, exact), "names-missed")
    buckets = kb.filter("table_name = 'app_s3_paths'").select("app_id", F.regexp_replace("name", "^s3://", "").alias("path")).filter(F.contains("path", F.lit("/"))).select("app_id", F.split("path", "/")[0].alias("q")).distinct()
    held = missed.join(buckets.hint("shuffle_hash"), ["app_id", "q"], "left_semi")
    bucket = held.select("app_id", "q", F.lit("app_s3_paths").alias("table_name"), F.col("q").alias("name"), F.lit("bucket").alias("how"), F.lit(True).alias("resolved"), F.lit(1.0).alias("confidence"))
    fuzzy = out(_containing(stage(left(missed, bucket), "names-open"), kb), "contains", 0.5)
    found = exact.unionByName(bucket).unionByName(fuzzy)
    w = Window.partitionBy("app_id", "q").orderBy("table_name", "name")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def open_feedback(feedback: DataFrame, app: str, unit: str | None = None, artifact: str | None = None) -> DataFrame:
    """Open rows of an application, oldest first."""
    out = feedback.filter((F.col("status") == "open") & (F.col("app_id") == app))
    if unit is not None:
        out = out.filter(F.col("unit") == unit)
    if artifact is not None:
        out = out.filter(F.col("artifact") == artifact)
    return out.orderBy("created_at", "id")


def validate_feedback(feedback: DataFrame) -> DataFrame:
    """Rows with the sorted list of rules they break."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "app_id": blank("app_id"), "unit": blank("unit"), "artifact": ~F.coalesce(F.col("artifact").isin(*vocab.ARTIFACTS), F.lit(False)), "action": ~F.coalesce(F.col("action").isin(*vocab.FEEDBACK_ACTIONS), F.lit(False)),
        "status": ~F.coalesce(F.col("status").isin(*vocab.STATUSES), F.lit(False)), "comment": F.col("action").isin("reject", "comment") & blank("comment"),
    }
    return feedback.withColumn("errors", F.sort_array(F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()]))))


def validate_labels(labels: DataFrame, expected: DataFrame) -> DataFrame:
    """Ids with what is wrong: unknown enum values, duplicates, missing, unexpected."""
    bad = labels.filter(~F.col("stage").isin(*vocab.STAGES) | ~F.col("intent").isin("positive", "negative", "neutral")).select("id", F.lit("enum").alias("problem"))
    twice = labels.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate").alias("problem"))
    missing = expected.select("id").join(labels.select("id"), "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    extra = labels.select("id").distinct().join(expected.select("id"), "id", "left_anti").select("id", F.lit("unexpected").alias("problem"))
    return bad.unionByName(twice).unionByName(missing).unionByName(extra).distinct()


def facts_of_file(facts: DataFrame, path: str, unresolved_only: bool = False) -> DataFrame:
    """C8"""
    out = facts.filter(F.col("file_path") == path)
    return out.filter(~F.col("resolved")) if unresolved_only else out


def facts_of(facts: DataFrame, subject: str | None = None, human: bool = False) -> DataFrame:
    """C11: facts of one subject, or those that a person stamped."""
    out = facts if subject is None else facts.filter(F.col("subject") == subject)
    return out.filter("extraction_method = 'human'") if human else out


def human_sections(docs: DataFrame) -> DataFrame:
    """(unit, section) of sections that a person confirmed."""
    return docs.select("unit", F.explode(F.map_keys(F.map_filter("section_provenance", lambda _, v: v == "human"))).alias("section"))


def requirement_lookup(units: DataFrame, requirements: DataFrame) -> DataFrame:
    """One row a requested unit; ``found`` is false where there is no document."""
    one = latest(requirements, ["app_id", "unit"], [F.col("id").desc()])
    return units.join(one, ["app_id", "unit"], "left").withColumn("found", F.col("id").isNotNull())


def spec_inventory_join(requirements: DataFrame, functions: DataFrame) -> DataFrame:
    """Matched rows by application; duplicate symbols count again.

    Both sides are counted by application and name first, so equal rows don't meet one by one.
    """
    asked = requirements.groupBy("app_id", F.col("unit").alias("symbol")).agg(F.count("*").alias("asked"))
    have = functions.groupBy("app_id", "symbol").agg(F.count("*").alias("have"))
    return asked.join(have.hint("merge"), ["app_id", "symbol"]).groupBy("app_id").agg(F.sum(F.col("asked") * F.col("have")).alias("matched"))


def orphans(docs: DataFrame, apps: DataFrame) -> DataFrame:
    """Documents of no known application."""
    return docs.join(apps.select("app_id"), "app_id", "left_anti")


def grounding_gate(claims: DataFrame, kb: DataFrame) -> DataFrame:
    """``claims(entry, app_id, name)`` with a verdict: confirmed only by a resolved exact match."""
    known = kb.groupBy("app_id", "name").agg(F.max(F.coalesce("resolved", F.lit(True))).alias("ok"))
    return claims.join(known, ["app_id", "name"], "left").select("entry", "app_id", "name", F.when(F.col("ok"), "confirmed").when(F.col("ok").isNotNull(), "unresolved").otherwise("unknown").alias("verdict"))


def coverage_gap(inventory: DataFrame, accounted: DataFrame, skipped_types: Sequence[str], chains: DataFrame | None = None) -> DataFrame:
    """``inventory(type, name)`` less skipped types, accounted names and members of accounted chains."""
    left = inventory.filter(~F.col("type").isin(*skipped_types))
    left = left.join(accounted.select("name"), "name", "left_anti").join(accounted.select(F.col("name").alias("id")), F.concat("type", F.lit(":"), left["name"]) == F.col("id"), "left_anti")
    if chains is not None:
        members = chains.join(accounted.select(F.col("name").alias("chain")), "chain", "left_semi").select("member").distinct()
        left = left.join(members, F.concat("type", F.lit(":"), left["name"]) == F.col("member"), "left_anti")
    return left


def feedback_gate(feedback: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids of rejects and comments that no entry lists as addressed."""
    addressed = entries.select(F.explode("feedback_ids").alias("id")).distinct()
    return feedback.filter(F.col("action").isin("reject", "comment")).select("id").join(addressed.hint("merge"), "id", "left_anti")


def story_gate(docs: DataFrame, facts: DataFrame, observable: Sequence[str] = vocab.OBSERVABLE) -> DataFrame:
    """Units of ``docs(unit, name)`` none of whose names is an observable object."""
    seen = facts.filter(F.col("predicate").isin(*observable)).select(F.col("object").alias("name")).distinct()
    grounded = docs.join(seen, "name", "left_semi").select("unit").distinct()
    return docs.select("unit").distinct().join(grounded, "unit", "left_anti")


def inventory(entities: DataFrame, cap: int = 100) -> DataFrame:
    """Names by type with their count; the list is capped, the count isn't."""
    w = Window.partitionBy("type").orderBy("name")
    top = entities.select("type", "name").distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    counts = entities.groupBy("type").agg(F.count_distinct("name").alias("n"))
    return counts.join(top.groupBy("type").agg(F.sort_array(F.collect_list("name")).alias("names")), "type")


def chain_members(facts: DataFrame) -> DataFrame:
    """E25"""
    return facts.filter("predicate IN ('HAS_MEMBER', 'STARTS_AT')").groupBy(F.col("subject").alias("chain")).agg(F.sort_array(F.collect_set("object")).alias("members"))
