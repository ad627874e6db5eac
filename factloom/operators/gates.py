"""Gate outcomes, findings, coverage metrics and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from .text import strip


def gate_cascade(outcomes: DataFrame, order: Sequence[int] = vocab.GATE_ORDER) -> DataFrame:
    """(bundle, delivered, failed_gate, passed): gates in cost order, first FAIL stops, SKIP passes."""
    rank = F.array_position(F.array(*[F.lit(g) for g in order]), F.col("gate"))
    o = outcomes.withColumn("rank", rank)
    first = F.min_by(F.when(F.col("status") == "FAIL", F.col("gate")), F.when(F.col("status") == "FAIL", F.col("rank")))
    return o.groupBy("bundle").agg((F.count_if(F.col("status") == "FAIL") == 0).alias("delivered"), first.alias("failed_gate"), F.count_if(F.col("status") == "PASS").alias("passed"))


def gate_evidence(outcomes: DataFrame) -> DataFrame:
    """(bundle, key, n): sums of the counts in ``outcomes(bundle, data map)``, such as mutants caught or lines covered."""
    return outcomes.select("bundle", F.explode("data").alias("key", "value")).groupBy("bundle", "key").agg(F.sum("value").alias("n"))


def stability(runs: DataFrame) -> DataFrame:
    """Bundles with one distinct verdict over their runs."""
    return runs.groupBy("bundle").agg((F.count_distinct("status") == 1).alias("stable"), F.count("*").alias("runs"))


def kill_count(runs: DataFrame) -> DataFrame:
    """``runs(bundle, mutant, passed)``, mutant NULL for the baseline: FAIL if the baseline fails or nothing is caught, SKIP without mutants."""
    g = runs.groupBy("bundle").agg(F.coalesce(F.bool_and(F.when(F.col("mutant").isNull(), F.col("passed"))), F.lit(True)).alias("base"), F.count("mutant").alias("mutants"), F.count_if(F.col("mutant").isNotNull() & ~F.col("passed")).alias("caught"))
    return g.select("bundle", "mutants", "caught", F.when(~F.col("base"), "FAIL").when(F.col("mutants") == 0, "SKIP").when(F.col("caught") > 0, "PASS").otherwise("FAIL").alias("verdict"))


def covered_changes(covered: DataFrame, changed: DataFrame) -> DataFrame:
    """(bundle, changed, covered, verdict): SKIP if nothing changed, FAIL if no changed line is covered."""
    hit = changed.join(covered.select("bundle", "file", "line").distinct(), ["bundle", "file", "line"], "left_semi").groupBy("bundle").agg(F.count("*").alias("covered"))
    every = covered.select("bundle").distinct().join(changed.groupBy("bundle").agg(F.count("*").alias("changed")), "bundle", "left").join(hit, "bundle", "left")
    n, c = F.coalesce("changed", F.lit(0)), F.coalesce("covered", F.lit(0))
    return every.select("bundle", n.alias("changed"), c.alias("covered"), F.when(n == 0, "SKIP").when(c == 0, "FAIL").otherwise("PASS").alias("verdict"))


def finding_report(findings: DataFrame) -> DataFrame:
    """By bundle: errors, warnings and whether there is no error."""
    return findings.groupBy("bundle").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"), (F.count_if(F.col("severity") == "ERROR") == 0).alias("ok"))


def finding_counts(findings: DataFrame) -> DataFrame:
    """(bundle, severity, rule, n)."""
    return findings.groupBy("bundle", "severity", "rule").agg(F.count("*").alias("n"))


def duplicate_steps(defs: DataFrame) -> DataFrame:
    """Definitions of one (type, pattern) at several sites, each with how many others there are."""
    many = defs.groupBy("type", "pattern").agg(F.count("*").alias("n")).filter("n > 1")
    return defs.join(many, ["type", "pattern"]).select("type", "pattern", "site", (F.col("n") - 1).alias("others"))


def compliance_findings(steps: DataFrame, scenario: str = "at") -> DataFrame:
    """(feature_file, scenario, name, rule, severity) of ``steps(feature_file, scenario, name, pos, keyword, text)``.

    Errors: a blank name, no Given, When or Then, an empty step.  A warning: a step other
    than And or But that belongs before the latest Given, When or Then.
    """
    key = ["feature_file", scenario]
    rank = lambda c: F.when(c == "Given", 0).when(c == "When", 1).when(c == "Then", 2).when(c.isin("And", "But"), 3).otherwise(1)
    word, before = F.col("keyword"), Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(word.isin("Given", "When", "Then"), rank(word)), ignorenulls=True).over(before)
    rows = steps.withColumn("late", F.coalesce(~word.isin("And", "But") & (rank(word) < last), F.lit(False)))
    has = lambda w: F.bool_or(word == w)
    per = rows.groupBy(*key).agg(F.first("name").alias("name"), *[has(w).alias(w) for w in ("Given", "When", "Then")], F.count_if(F.trim("text") == "").alias("empty"), F.bool_or("late").alias("late"))
    found = lambda broken, rule, severity="ERROR": F.when(broken, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    one = F.array_compact(F.array(found(F.trim("name") == "", "scenario-name-required"), *[found(~F.col(w), f"{w.lower()}-required") for w in ("Given", "When", "Then")], found(F.col("late"), "keyword-order", "WARNING")))
    empty = F.array_repeat(F.struct(F.lit("empty-step").alias("rule"), F.lit("ERROR").alias("severity")), F.col("empty").cast("int"))
    return per.select(*key, "name", F.explode(F.concat(one, empty)).alias("f")).select(*key, "name", "f.rule", "f.severity")


def compliance(steps: DataFrame, scenario: str = "at") -> DataFrame:
    """By file: scenarios, those that pass, percent.  Names with an error fail once, however many scenarios share them."""
    count = steps.groupBy("feature_file").agg(F.count_distinct(scenario).alias("scenarios"))
    failing = compliance_findings(steps, scenario).filter("severity = 'ERROR'").groupBy("feature_file").agg(F.count_distinct("name").alias("failing"))
    ok = F.col("scenarios") - F.coalesce("failing", F.lit(0).cast("long"))
    return count.join(failing.hint("merge"), "feature_file", "left").select("feature_file", "scenarios", ok.alias("ok")).withColumn("pct", F.greatest(F.lit(0.0), 100.0 * F.col("ok") / F.col("scenarios")))


def action_coverage(ref: DataFrame, matched: DataFrame) -> DataFrame:
    """By application: share of reference actions that matched candidates have too; no actions = 100."""
    acts = ref.select("app_id", F.explode("actions").alias("a")).distinct()
    hit = matched.select("app_id", F.explode(F.array_intersect("actions", "actions2")).alias("a")).distinct()
    n = acts.groupBy("app_id").agg(F.count("*").alias("n")).hint("merge").join(acts.join(hit.hint("merge"), ["app_id", "a"], "left_semi").groupBy("app_id").agg(F.count("*").alias("k")), "app_id", "left")
    return ref.select("app_id").distinct().join(n.hint("merge"), "app_id", "left").select("app_id", F.when(F.col("n") > 0, 100.0 * F.coalesce("k", F.lit(0)) / F.col("n")).otherwise(100.0).alias("action_coverage"))


def path_coverage(ref: DataFrame, matched_ids: DataFrame) -> DataFrame:
    """Percent of positive and of negative reference scenarios matched; none = 100."""
    m = ref.join(matched_ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    pct = lambda kind: F.when(F.count_if(F.col("intent") == kind) > 0, 100.0 * F.count_if((F.col("intent") == kind) & F.col("hit")) / F.count_if(F.col("intent") == kind)).otherwise(100.0)
    return m.groupBy("app_id").agg(pct("positive").alias("positive"), pct("negative").alias("negative"))


def uncovered(ref: DataFrame, matched_ids: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` (stage, feature_file) of the reference that no match has."""
    hit = ref.join(matched_ids.select("id"), "id", "left_semi").select("app_id", column).distinct()
    return ref.select("app_id", column).distinct().exceptAll(hit)


def coverage_of(ref: DataFrame, matched_ids: DataFrame, column: str) -> DataFrame:
    """Percent of the distinct values of ``column`` that some match has."""
    m = ref.join(matched_ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return m.groupBy("app_id", column).agg(F.max("hit").alias("hit")).groupBy("app_id").agg((100.0 * F.count("hit") / F.count("*")).alias("pct"))


def precision_efficiency(counts: DataFrame) -> DataFrame:
    """From (n_gen, matched, redundant_matched, covered)."""
    n = F.col("n_gen")
    return counts.withColumns({"precision": F.when(n > 0, 100.0 * F.greatest(F.lit(0), F.col("matched") - F.col("redundant_matched")) / n).otherwise(0.0), "efficiency": F.when(n > 0, F.least(F.lit(100.0), 100.0 * F.col("covered") / n)).otherwise(0.0)})


def overall(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of a row's metrics, in the order of the weights."""
    total = F.lit(0.0)
    for name, w in (weights or vocab.WEIGHTS_MANUAL).items():
        total = total + F.lit(w) * F.col(name)
    return metrics.withColumn("overall", total)


def integrity(steps: DataFrame, outlines: DataFrame, docs: DataFrame, sections: DataFrame, items: DataFrame, reported: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """What went in, by suite: files, scenarios, steps, outline scenarios; and once for all suites the requirement
    documents, Markdown ones, their bytes, sections and items.

    ``steps(suite, feature_file, at, text)`` and ``outlines(suite)`` have a row a step and an
    outline scenario; ``docs(file, text)``, ``sections(file, body)``, ``items`` describe the
    requirements.  ``notes`` names each of ``reported`` counts of requirements that differs
    from what is there.  The second table has a ``note`` a document whose raw text isn't
    part of its sections.
    """
    suites = steps.groupBy("suite").agg(F.count_distinct("feature_file").alias("files"), F.count_distinct(F.struct("feature_file", "at")).alias("scenarios"), F.count("*").alias("steps"))
    suites = suites.join(outlines.groupBy("suite").agg(F.count("*").alias("outlines")).hint("merge"), "suite", "left").withColumn("outlines", F.coalesce("outlines", F.lit(0).cast("long")))
    joined = sections.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n").alias("joined"), F.count("*").alias("sections"))
    raw = strip("text")
    beside = (raw != "") & (strip("joined") != "") & ~F.contains("joined", raw)
    d = docs.join(joined.hint("merge"), "file", "left")
    one = d.agg(F.count("*").alias("requirement_files"), F.count_if(F.endswith(F.lower(F.col("file").cast("string")), F.lit(".md"))).alias("requirement_md_files"), F.sum(F.octet_length("text")).cast("long").alias("requirement_bytes"), F.sum(F.coalesce("sections", F.lit(0))).cast("long").alias("requirement_sections"))
    one = one.crossJoin(items.agg(F.count("*").alias("requirement_items")))  # one row each
    told = [F.when(F.col(k) != n, F.concat(F.lit(f"{k}: "), F.col(k).cast("string"), F.lit(f" parsed, {n} reported"))) for k, n in (reported or {}).items()]
    one = one.withColumn("notes", F.array_compact(F.array(*told).cast("array<string>")))
    files = d.filter(beside).select(F.concat(F.col("file").cast("string"), F.lit(": raw_text preserved alongside sections.")).alias("note"))
    return suites.crossJoin(one), files  # one row


def requirement_paths(items: DataFrame, matched_ids: DataFrame) -> DataFrame:
    """E15 for requirements: percent of the positive and of the negative criteria matched; none = 100."""
    return path_coverage(items.withColumn("intent", F.when(F.col("is_negative"), "negative").otherwise("positive")), matched_ids)


def unit_traceability(items: DataFrame, matches: DataFrame, nearby: DataFrame) -> DataFrame:
    """By unit: criteria, covered ones, their percent, sorted generated names, and the same counts of ``nearby(unit, manual, covered)`` manual scenarios; none = 100."""
    j = items.join(matches.select("id", "generated"), "id", "left")
    out = j.groupBy("unit").agg(F.count_distinct("id").alias("criteria"), F.count_distinct(F.when(F.col("generated").isNotNull(), F.col("id"))).alias("covered"), F.sort_array(F.collect_set("generated")).alias("generated")).withColumn("pct", F.when(F.col("criteria") > 0, 100.0 * F.col("covered") / F.col("criteria")).otherwise(100.0))
    near = nearby.groupBy("unit").agg(F.count_distinct("manual").alias("nearby"), F.count_distinct(F.when(F.col("covered"), F.col("manual"))).alias("nearby_covered"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = out.join(near.hint("merge"), "unit", "left").select(*out.columns, zero("nearby"), zero("nearby_covered"))
    return out.withColumn("nearby_pct", F.when(F.col("nearby") > 0, 100.0 * F.col("nearby_covered") / F.col("nearby")).otherwise(100.0))


STANDARDS = ("required_tags", "forbidden_tags", "scenario_name_must_include", "max_scenarios_per_feature", "require_feature_description", "severity")


def load_standards(config: dict) -> dict:
    """The checked config; unknown keys and wrong types are errors, so that a typing slip can't switch a rule off."""
    if not isinstance(config, dict) or set(config) - set(STANDARDS):
        raise ValueError(f"not a config of {', '.join(STANDARDS)}: {config}")
    for key in STANDARDS[:3]:
        if not (isinstance(config.get(key, []), list) and all(isinstance(x, str) and x.strip() for x in config.get(key, []))):
            raise ValueError(f"{key} is a list of texts that aren't blank")
    limit = config.get("max_scenarios_per_feature", 1)
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
        raise ValueError("max_scenarios_per_feature is a whole number above 0")
    if not isinstance(config.get("require_feature_description", True), bool):
        raise ValueError("require_feature_description is true or false")
    if config.get("severity", "ERROR") not in ("ERROR", "WARNING"):
        raise ValueError("severity is ERROR or WARNING")
    return {k: [x.strip() for x in v] if isinstance(v, list) else v for k, v in config.items()}


def check_standards(features: DataFrame, scenarios: DataFrame, config: dict) -> DataFrame:
    """(feature_file, line, name, rule, severity, symbol): what breaks a team rule; ``name`` is NULL for a whole file.

    ``features(feature_file, line, tags, description)`` has a row a file and
    ``scenarios(feature_file, line, name, tags)`` a row a scenario, with the tags of its
    feature (``text.scan_headers`` gives both).  A name must hold one of the markers, as
    written.  Without any file there is one warning of rule ``nothing-to-check``.
    """
    config = load_standards(config)
    rules = {k: v for k, v in config.items() if k != "severity"}
    severity, nothing = config.get("severity", "ERROR"), F.lit(None).cast("string")
    words = lambda key: F.array(*[F.lit(x) for x in config.get(key, [])]).cast("array<string>")
    kind = "array<struct<rule:string,symbol:string>>"
    found = lambda broken, rule, symbol=nothing: F.when(broken, F.struct(F.lit(rule).alias("rule"), symbol.alias("symbol")))
    tagged = lambda c: F.transform(F.array_sort(F.array_intersect(words("forbidden_tags"), c)), lambda t: F.struct(F.lit("forbidden-tag").alias("rule"), t.alias("symbol"))).cast(kind)
    per = scenarios.groupBy("feature_file").agg(F.count("*").alias("n"))
    files = features.join(per.hint("merge"), "feature_file", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    limit = config.get("max_scenarios_per_feature")
    whole = F.array_compact(F.array(found(~F.col("description") & F.lit(bool(config.get("require_feature_description"))), "feature-description"), found(F.col("n") > limit if limit else F.lit(False), "max-scenarios"))).cast(kind)
    at_least_1 = F.greatest("line", F.lit(1))
    out = files.select("feature_file", at_least_1.alias("line"), nothing.alias("name"), F.explode(F.concat(whole, tagged(F.col("tags")))).alias("r"))
    s = scenarios.join(features.select("feature_file", F.col("tags").alias("file_tags")).hint("merge"), "feature_file")
    missing = F.array_except(words("required_tags"), "tags")
    markers = config.get("scenario_name_must_include", [])
    named = F.lit(not markers)
    for m in markers:
        named = named | F.contains("name", F.lit(m))
    own = F.array_compact(F.array(found(F.size(missing) > 0, "required-tag", F.try_element_at(missing, F.lit(1))), found(~named, "scenario-name"))).cast(kind)
    rows = s.select("feature_file", "line", "name", F.explode(F.concat(own, tagged(F.array_except("tags", "file_tags")))).alias("r"))
    out = out.unionByName(rows).select("feature_file", "line", "name", "r.rule", F.lit(severity).alias("severity"), "r.symbol")
    if not rules:
        return out.filter("false")
    empty = features.agg(F.count("*").alias("n")).filter("n = 0")
    return out.unionByName(empty.select(nothing.alias("feature_file"), F.lit(0).alias("line"), nothing.alias("name"), F.lit("nothing-to-check").alias("rule"), F.lit("WARNING").alias("severity"), nothing.alias("symbol")))


def spec_checklist(spec: DataFrame) -> DataFrame:
    """Count and presence of each section of a one-row-per-entry spec."""
    return spec.groupBy("section").agg(F.count("entry").alias("n")).withColumn("status", F.when(F.col("n") > 0, "present").otherwise("missing"))


def merge_facts(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """G1: one row a key over all sources: the first source that has it and how many rows say so."""
    rows = None
    for n, df in enumerate(sources):
        own = df.select(*keys, F.lit(n).alias("source"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(*keys).agg(F.min("source").alias("source"), F.count("*").alias("n"))


def requirement_only(requirement: DataFrame, manual: DataFrame) -> DataFrame:
    """Generated scenarios that requirements match and manual scenarios don't."""
    return requirement.select("generated").distinct().join(manual.select("generated").distinct(), "generated", "left_anti")


def id_diff(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(id, side) missing or unexpected."""
    a, b = expected.select("id").distinct(), got.select("id").distinct()
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("unexpected")))
