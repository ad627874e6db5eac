"""Facts that documents declare: deployment manifests, state machines, workflows, example rows, coverage tables.

A document is parsed once into JSON; from there on everything is columns: maps and arrays
are exploded, nesting is followed level by level.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.staged import stage
from .enrich import step_lineage
from .text import lines

MANIFEST = "functions map<string,struct<handler:string,events:array<map<string,string>>>>, stateMachines map<string,struct<definition:string>>"
MACHINE = "StartAt string, States map<string,string>"
BODY = "struct<StartAt:string,States:map<string,string>>"
STATE = f"Next string, Resource string, Parameters struct<FunctionName:string>, Choices array<struct<Next:string>>, Default string, Catch array<struct<Next:string>>, Branches array<{BODY}>, Iterator {BODY}, ItemProcessor {BODY}"
KNOWN = ("EXTRACT", "LOAD", "MERGE", "PURGE", "EXECUTE", "TRANSFORM")
PRODUCERS = ("EXTRACT", "MERGE", "TRANSFORM")


def _yaml_json(text: str) -> str | None:
    """JSON of one YAML document, written event by event, so that its values are never held as objects; NULL for what holds no mapping.

    Anchors, tags, merged and repeated keys and deep nesting concern the document as a whole and are left to the loader.
    """
    import yaml

    kind = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def whole() -> str | None:
        doc = yaml.load(text, Loader=kind)
        return json.dumps(doc, default=str) if isinstance(doc, dict) else None

    loader, out = kind(text), bytearray()
    open_: list[list] = []  # of each collection: keys so far, or None for a list; whether a value comes next; whether one was written
    try:
        loader.get_event()
        if loader.check_event(yaml.StreamEndEvent):
            return None
        loader.get_event()
        if not loader.check_event(yaml.MappingStartEvent):
            return whole()
        while True:
            e = loader.get_event()
            if isinstance(e, yaml.DocumentEndEvent):
                return out.decode() if loader.check_event(yaml.StreamEndEvent) else whole()
            if isinstance(e, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
                out += b"]" if open_.pop()[0] is None else b"}"
                continue
            if isinstance(e, yaml.AliasEvent) or e.anchor is not None or e.tag is not None or len(open_) > 50:
                return whole()
            top = open_[-1] if open_ else None
            key = top is not None and top[0] is not None and not top[1]
            if top is not None:
                if (key or top[0] is None) and top[2]:
                    out += b", "
                top[2] = True
                if top[0] is not None:
                    top[1] = not top[1]
            if not isinstance(e, yaml.ScalarEvent):
                if key:
                    return whole()
                mapping = isinstance(e, yaml.MappingStartEvent)
                open_.append([set() if mapping else None, False, False])
                out += b"{" if mapping else b"["
                continue
            tag = loader.resolve(yaml.ScalarNode, e.value, e.implicit)
            if key and (tag != "tag:yaml.org,2002:str" or e.value in top[0]):
                return whole()
            value = e.value if tag == "tag:yaml.org,2002:str" else loader.construct_document(yaml.ScalarNode(tag, e.value, e.start_mark, e.end_mark))
            out += json.dumps(value, default=str).encode()
            if key:
                top[0].add(e.value)
                out += b": "
    finally:
        loader.dispose()


def as_json(files: DataFrame) -> DataFrame:
    """(file, json) of ``files(file, text)`` in YAML or JSON; NULL for what is neither or holds no mapping."""

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def one(text: str | None) -> str | None:
            try:
                return _yaml_json(text or "")
            except (yaml.YAMLError, ValueError, RecursionError):
                return None

        for pdf in frames:
            some, size = [], 0
            for file, text in zip(pdf["file"], pdf["text"]):
                some.append((file, one(text)))
                size += len(text or "")
                if size > 1 << 24 or len(some) == 1000:
                    yield pd.DataFrame(some, columns=["file", "json"])
                    some, size = [], 0
            if some:
                yield pd.DataFrame(some, columns=["file", "json"])

    return files.select(F.col("file").cast("string").alias("file"), F.col("text").cast("string").alias("text")).mapInPandas(convert, "file string, json string")


def _event_source(kind: Column, value: Column) -> tuple[Column, Column]:
    """(node, known) of a trigger; its value is a scalar or an object in JSON."""
    field = lambda *keys: F.when(F.startswith(value, F.lit("{")), F.coalesce(*[F.get_json_object(value, f"$.{k}") for k in keys])).otherwise(value)
    of = lambda name, c: (F.concat(F.lit(f"{name}:"), F.coalesce(c, F.lit("<unknown>"))), c.isNotNull())
    call = F.when(field("path").isNotNull(), F.concat_ws(" ", F.upper(F.coalesce(field("method"), F.lit("GET"))), field("path")))
    kinds = {"s3": of("S3Bucket", field("bucket")), "schedule": of("Schedule", field("rate", "cron")), "sqs": of("Queue", S.arn_name(field("arn"))), "sns": of("Topic", S.arn_name(field("arn", "topicName"))), "http": of("APIEndpoint", call), "httpApi": of("APIEndpoint", call)}
    node, known = F.concat(F.lit("EventSource:"), kind), F.lit(False)
    for k, (n, sure) in kinds.items():
        node, known = F.when(kind == k, n).otherwise(node), F.when(kind == k, sure).otherwise(known)
    return node, known


def manifest_facts(docs: DataFrame) -> DataFrame:
    """(file, subject, predicate, object, resolved, confidence) of deployment manifests in ``docs(file, json)``.

    A manifest has a function with a handler; others give nothing.
    """
    m = docs.withColumn("m", F.from_json("json", MANIFEST)).filter(F.exists(F.map_values("m.functions"), lambda s: s["handler"].isNotNull()))
    fn = m.select("file", F.explode("m.functions").alias("name", "spec")).filter("spec IS NOT NULL").select("file", F.concat(F.lit("LambdaFunction:"), S.arn_name("name")).alias("subject"), "spec")
    handler = F.col("spec.handler")
    handled = fn.filter(F.contains(handler, F.lit("."))).select("file", "subject", F.lit("HANDLED_BY").alias("predicate"), F.concat(F.lit("Function:"), S.handler_to_function(handler), F.lit("."), F.substring_index(handler, ".", -1)).alias("object"), F.lit(True).alias("resolved"))
    events = fn.select("file", "subject", F.explode("spec.events").alias("e")).filter(F.size("e") == 1)
    node, known = _event_source(F.map_keys("e")[0], F.map_values("e")[0])
    fed = events.select("file", "subject", F.lit("RECEIVES_EVENT").alias("predicate"), node.alias("object"), known.alias("resolved"))
    return handled.unionByName(fed).withColumn("confidence", F.when(F.col("resolved"), 1.0).otherwise(0.5))


def machine_names(docs: DataFrame) -> DataFrame:
    """(file, machine): the names that manifests give to definition files."""
    m = docs.select(F.explode(F.from_json("json", MANIFEST)["stateMachines"]).alias("machine", "spec")).filter("spec.definition IS NOT NULL")
    return m.groupBy(F.regexp_replace("spec.definition", r"^(\./)+", "").alias("file")).agg(F.max("machine").alias("machine"))


def machine_states(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Machines (file, machine, named, start) and their states (file, machine, named, name, s, inner) of ``docs(file, json)``.

    Without a name from a manifest the file's own name stands in.  Nesting (branches of
    Parallel, bodies of Map, ``inner``) is followed one level a round.
    """
    docs = stage(docs, "documents")  # parsed once
    top = docs.withColumn("m", F.from_json("json", MACHINE)).filter("m.StartAt IS NOT NULL AND m.States IS NOT NULL").join(machine_names(docs).hint("merge"), "file", "left")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    top = stage(top.select("file", F.coalesce("machine", stem).alias("machine"), F.col("machine").isNotNull().alias("named"), "m"), "machines")
    level, every = top.select("file", "machine", "named", F.explode("m.States").alias("name", "text")), None
    while True:
        st = level.filter(F.startswith("text", F.lit("{"))).withColumn("s", F.from_json("text", STATE)).drop("text")
        inner = F.filter(F.concat(F.coalesce("s.Branches", F.array().cast(f"array<{BODY}>")), F.array("s.Iterator", "s.ItemProcessor")), lambda x: x["States"].isNotNull())
        st = stage(st.withColumn("inner", inner), "states")
        every = st if every is None else every.unionByName(st)
        deeper = st.filter(F.size("inner") > 0)
        if deeper.isEmpty():
            return top.select("file", "machine", "named", F.col("m.StartAt").alias("start")), every
        level = deeper.select("file", "machine", "named", F.explode("inner").alias("sub")).select("file", "machine", "named", F.explode("sub.States").alias("name", "text"))


def state_machine_facts(docs: DataFrame, states: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Facts of state machines: FEEDS to each successor and branch head, INVOKES_LAMBDA of tasks.

    A machine that no manifest names is unresolved, and so is what it does.
    """
    top, st = states or machine_states(docs)
    state = lambda c: F.concat(F.lit("State:"), "machine", F.lit("::"), c)
    none = F.array().cast("array<string>")
    start = top.select("file", F.concat(F.lit("StateMachine:"), "machine").alias("subject"), F.lit("FEEDS").alias("predicate"), state(F.col("start")).alias("object"), F.col("named").alias("resolved"))
    more = lambda c: F.coalesce(F.transform(c, lambda x: x["Next"]), none)
    nexts = F.array_compact(F.concat(F.array("s.Next"), more("s.Choices"), F.array("s.Default"), more("s.Catch"), F.transform("inner", lambda x: x["StartAt"])))
    feeds = st.select("file", state(F.col("name")).alias("subject"), F.lit("FEEDS").alias("predicate"), "machine", "named", F.explode(nexts).alias("next")).select("file", "subject", "predicate", state(F.col("next")).alias("object"), F.col("named").alias("resolved"))
    res = F.col("s.Resource")
    task = F.when(F.endswith(res, F.lit(":lambda:invoke")), S.arn_name(F.col("s.Parameters.FunctionName"))).when(F.contains(res, F.lit(":function:")), S.arn_name(res)).when((res != "") & ~F.contains(res, F.lit(":")), res)
    runs = st.withColumn("task", task).filter("task IS NOT NULL").select("file", state(F.col("name")).alias("subject"), F.lit("INVOKES_LAMBDA").alias("predicate"), F.concat(F.lit("LambdaFunction:"), "task").alias("object"), (F.col("named") & ~S.has_token("task")).alias("resolved"))
    return start.unionByName(feeds).unionByName(runs).withColumn("confidence", F.when(F.col("resolved"), 1.0).otherwise(0.5))


def wiring_entities(docs: DataFrame, states: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(file, id, type, name) of declared functions, their event sources, state machines and states, one row a file and id."""
    m = docs.withColumn("m", F.from_json("json", MANIFEST)).filter(F.exists(F.map_values("m.functions"), lambda s: s["handler"].isNotNull()))
    fn = m.select("file", F.explode("m.functions").alias("name", "spec")).filter("spec IS NOT NULL")
    out = fn.select("file", F.concat(F.lit("LambdaFunction:"), S.arn_name("name")).alias("id"), F.lit("LambdaFunction").alias("type"), "name")
    sources = manifest_facts(docs).filter("predicate = 'RECEIVES_EVENT'").select("file", F.col("object").alias("id"), F.substring_index("object", ":", 1).alias("type"), F.col("object").alias("name"))
    top, st = states or machine_states(docs)
    machines = top.select("file", F.concat(F.lit("StateMachine:"), "machine").alias("id"), F.lit("StateMachine").alias("type"), F.col("machine").alias("name"))
    name = F.concat_ws("::", "machine", "name")
    inner = st.select("file", F.concat(F.lit("State:"), name).alias("id"), F.lit("State").alias("type"), name.alias("name"))
    return out.unionByName(sources).unionByName(machines).unionByName(inner).dropDuplicates(["file", "id"])


def workflow_steps(docs: DataFrame) -> DataFrame:
    """(file, pos, step, action, body) of the actions of workflow documents in ``docs(file, json)``, staged: documents are parsed once."""
    rows = docs.select("file", F.posexplode(F.from_json("json", "actions array<string>")["actions"]).alias("pos", "body")).withColumn("action", F.get_json_object("body", "$.action")).filter("action IS NOT NULL")
    name = F.coalesce(F.nullif(F.get_json_object("body", "$.name"), F.lit("")), F.concat_ws("_", F.lower("action"), F.col("pos").cast("string")))
    return stage(rows.select("file", "pos", F.concat(F.lit("Step:"), "file", F.lit("::"), name).alias("step"), "action", "body"), "workflow-steps")


def workflow_facts(steps: DataFrame) -> DataFrame:
    """Facts of ``workflow_steps``: the file defines its steps, steps read and write, dataframes feed steps.

    Of an action that isn't known, tables and paths written by convention are kept, unresolved.
    """
    get = lambda k: F.get_json_object("body", f"$.{k}")
    action, backbone = F.col("action"), F.nullif(S.backbone(get("dataBackbone")), F.lit(""))
    fact = lambda p, o, resolved, sure: F.when(o.isNotNull(), F.struct(F.lit(p).alias("predicate"), o.alias("object"), resolved.alias("resolved"), sure.alias("confidence")))
    typed = lambda t, c: F.concat(F.lit(f"{t}:"), c)
    whole, known = F.lit(1.0), lambda c: ~S.has_token(c)
    path = F.coalesce(get("dataFileLocation"), F.when(get("dataS3Bucket").isNotNull(), F.concat(F.lit("s3://"), get("dataS3Bucket"), F.lit("/"), F.coalesce(get("dataS3Prefix"), F.lit("")))))
    load, table = action == "LOAD", get("table")
    found = F.array_distinct(F.regexp_extract_all("body", F.lit(r"(s3://[^\s'\"\\]+|\$\{[\w.]+\.(?:glue_table_name|glue_database_name|s3_bucket|s3_prefix)\})"), F.lit(1)))
    drift = F.transform(F.when(~action.isin(*KNOWN), found).otherwise(F.array().cast("array<string>")), lambda r: F.struct(F.when(F.startswith(r, F.lit("s3://")), "WRITES_TO_S3").otherwise("QUERIES_DATABASE").alias("predicate"), F.concat(F.when(F.startswith(r, F.lit("s3://")), "S3Object:").otherwise("Table:"), r).alias("object"), F.lit(False).alias("resolved"), F.lit(0.4).alias("confidence")))
    facts = F.concat(F.array_compact(F.array(
        fact("QUERIES_DATABASE", F.when(action.isin("EXTRACT", "MERGE"), typed("Table", backbone)), known(backbone), whole),
        fact("WRITES_DATABASE", F.when(load, typed("Table", backbone)), known(backbone), whole),
        fact("WRITES_DATABASE", F.when(load & backbone.isNull(), typed("Table", table)), known(table), F.lit(0.9)),
        fact("WRITES_TO_S3", F.when(load, typed("S3Object", path)), known(path), F.when(known(path), 1.0).otherwise(0.5)),
        fact("CALLS", F.when(action == "EXECUTE", typed("Symbol", get("customFunction"))), F.lit(True), whole),
    )), drift)
    own = steps.select("file", F.col("step").alias("subject"), F.explode(facts).alias("f")).select("file", "subject", "f.*")
    defines = steps.select("file", F.concat(F.lit("WorkflowFile:"), "file").alias("subject"), F.lit("DEFINES").alias("predicate"), F.col("step").alias("object"), F.lit(True).alias("resolved"), whole.alias("confidence"))
    makes = action.isin(*PRODUCERS)
    source = F.when(action == "TRANSFORM", get("srcDataframe")).when(~makes, F.coalesce(get("srcDataframe"), get("dataframe")))
    reads = F.array_distinct(F.array_compact(F.concat(F.array(source), F.coalesce(F.regexp_extract_all(get("sql"), F.lit(r"(?i)\b(?:from|join)\s+([a-z_][\w.]*)"), F.lit(1)), F.array().cast("array<string>")))))
    out = steps.select("file", "pos", "step", F.lit("out").alias("role"), F.when(makes, F.coalesce(get("dataframe"), get("trgDataframe"))).alias("df")).filter("df IS NOT NULL")
    used = steps.select("file", "pos", "step", F.lit("in").alias("role"), F.explode(reads).alias("df"))
    feeds = step_lineage(out.unionByName(used)).select("file", F.col("source").alias("subject"), F.lit("FEEDS").alias("predicate"), F.col("step").alias("object"), (F.col("confidence") == 1.0).alias("resolved"), "confidence")
    return defines.unionByName(own).unionByName(feeds)


def workflow_entities(steps: DataFrame) -> DataFrame:
    """(file, id, type, name) of workflow files and their steps, one row each."""
    files = steps.select("file").distinct().select("file", F.concat(F.lit("WorkflowFile:"), "file").alias("id"), F.lit("WorkflowFile").alias("type"), F.col("file").alias("name"))
    return files.unionByName(steps.select("file", F.col("step").alias("id"), F.lit("Step").alias("type"), S.name_of("step").alias("name")).distinct())


def unknown_actions(steps: DataFrame) -> DataFrame:
    """(file, action) that no rule knows, once each."""
    return steps.filter(~F.col("action").isin(*KNOWN)).select("file", "action").distinct()


def _cells(c: str) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(c), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))


def fixture_paths(files: DataFrame) -> DataFrame:
    """(file, pos, path) of the fixtures that the Examples rows of ``files(file, text)`` name.

    A row has five cells or more: name, kind, input, expected output, comparison; a row whose first cell is
    ``lambda_name`` or empty is a header.
    """
    rows = lines(files).filter(F.trim("line").rlike(r"^\|.*\|$")).withColumn("cells", _cells("line")).filter((F.size("cells") >= 5) & ~F.lower(F.col("cells")[0]).isin("lambda_name", ""))
    c = F.col("cells")
    made = F.array_compact(F.array(F.when(c[2] != "", F.concat(F.lit("input_payload/"), c[2])), F.when((F.lower(c[4]) == "full-comparison") & (c[3] != ""), F.concat(F.lit("expected_output_payload/"), c[3]))))
    return rows.select("file", "pos", F.explode(made).alias("path"))


def coverage_rows(files: DataFrame) -> DataFrame:
    """(file, pos, section, real, stub, gap, verdict) of the first table headed ``| Section``; it ends with the first line that is no row."""
    line = F.trim("line")
    head, bar = F.startswith(line, F.lit("| Section")), F.startswith(line, F.lit("|"))
    by = Window.partitionBy("file")
    rows = lines(files).withColumns({"head": head, "bar": bar, "cells": _cells("line")}).withColumn("start", F.min(F.when(F.col("head"), F.col("pos"))).over(by))
    row = (F.col("pos") > F.col("start")) & F.col("bar") & ~F.col("head") & ~F.col("line").rlike(r"^\|\s*-+") & (F.size("cells") >= 5) & ~F.startswith(F.lower(F.col("cells")[0]), F.lit("section"))
    rows = rows.withColumn("row", F.coalesce(row, F.lit(False))).withColumn("first", F.min(F.when(F.col("row"), F.col("pos"))).over(by))
    rows = rows.withColumn("end", F.min(F.when(~F.col("bar") & (F.col("pos") > F.col("first")), F.col("pos"))).over(by))
    kept = rows.filter("row AND (end IS NULL OR pos < end)")
    return kept.select("file", "pos", *[F.col("cells")[k].alias(n) for k, n in enumerate(("section", "real", "stub", "gap", "verdict"))])
