"""Scans: fact files, documents, features, parquet prefixes, bindings."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import latest
from .staged import sized, stage

RECORDS = "file string, kind string, at int, a string, b string, c string, extra string, error string"


def _fact_rows(path: str, section: str, entries: Iterator[tuple[int, object]]) -> Iterator[tuple]:
    """Records of numbered entries of one section; what can't be used keeps its stage, index, error and raw record (A2)."""
    for k, x in entries:
        if section == "entities":
            ok = isinstance(x, dict) and x.get("id")
            yield (path, "entity", k, x.get("id"), x.get("type"), x.get("name"), json.dumps(x.get("source") or {}, default=str), None) if ok else (path, "entity", k, None, None, None, json.dumps(x, default=str), "missing id")
        elif section == "quads":
            lack = [n for n in ("subject", "predicate", "object") if not (isinstance(x, dict) and x.get(n))]
            yield (path, "fact", k, None, None, None, json.dumps(x, default=str), "missing " + ", ".join(lack)) if lack else (path, "fact", k, x["subject"], x["predicate"], str(x["object"]), json.dumps(x.get("context") or {}, default=str), None)
        elif isinstance(x, dict) and str(x.get("text") or "").strip():
            yield (path, "note", k, x["text"], x.get("subject"), x.get("provenance"), None, None)


def _file_row(path: str, meta: dict) -> tuple:
    return (path, "file", 0, meta.get("app_id"), meta.get("language"), None, json.dumps(meta, default=str, sort_keys=True), None)


def _binding_rows(path: str, bindings: dict) -> Iterator[tuple]:
    return ((path, "binding", k, str(t), str(value), None, None, None) for k, (t, value) in enumerate(bindings.items()))


def _frames(rows: Iterator[tuple], at_once: int = 10_000) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, at_once)):
        yield pd.DataFrame(some, columns=[c.split()[0] for c in RECORDS.split(", ")])


def _yaml_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of each YAML fact file, held whole."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def rows() -> Iterator[tuple]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    doc = yaml.load(bytes(content), Loader=loader)
                    if not isinstance(doc, dict):
                        raise ValueError("not a mapping")
                except Exception as e:  # one bad file doesn't stop the others
                    yield (path, "file", 0, None, None, None, None, f"{type(e).__name__}: {e}")
                    continue
                yield _file_row(path, doc.get("metadata") or {})
                for section in LISTS:
                    yield from _fact_rows(path, section, enumerate(doc.get(section) or []))
                yield from _binding_rows(path, doc.get("bindings") or {})

    return _frames(rows())


#: Sections whose entries stand one a line below their head, and those that are one line.
LISTS, MAPS = ("entities", "quads", "notes"), ("metadata", "summary", "bindings")


def _line_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of lines (path, head, at, line); kind ``odd`` for a line that isn't of the form."""

    def one(path: str, head: str | None, at: int, line: str) -> list[tuple]:
        odd = [(path, "odd", 0, None, None, None, None, None)]
        if head is None or "\ufffd" in line:
            return odd
        if at < 0 and head not in MAPS:
            return []
        if at < 0:
            line = line[len(head) + 1 :]
        elif head in LISTS and line.startswith("- {"):
            line = line[2:]
        else:
            return odd
        try:
            x = json.loads(line, parse_constant=str)
        except (ValueError, RecursionError):
            return odd
        if at >= 0:
            return list(_fact_rows(path, head, iter([(at, x)])))
        return [_file_row(path, x)] if head == "metadata" else list(_binding_rows(path, x)) if head == "bindings" else []

    return _frames(row for pdf in batches for path, head, at, line in zip(pdf["path"], pdf["head"].where(pdf["head"].notna(), None), pdf["at"], pdf["line"]) for row in one(path, head, at, line))


def plain_path(path: str) -> str:
    """A path that a reader takes as it is, signs of patterns included."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def fact_records(spark: SparkSession, source: str | list[str], **options) -> DataFrame:
    """One row a record of the fact files in ``source``, staged.

    A file of the form that ``sinks.write_quads`` gives, a section or an entry a line, is
    split like any text: lines are numbered by block of the file and counted on over its
    blocks, and each is parsed by itself.  Any other file goes through one task, whole.
    """
    read = lambda kind, of=source: spark.read.format(kind).options(**options).load(of)
    files = sized(read("binaryFile").select("path", F.col("_metadata.file_path").alias("uri")), "fact-files")
    head = F.coalesce(F.nullif(F.regexp_extract("value", f"^({'|'.join(LISTS)}):$", 1), F.lit("")), F.nullif(F.regexp_extract("value", f"^({'|'.join(MAPS)}): [{{]", 1), F.lit("")), F.nullif(F.regexp_extract("value", rf"^((?:{'|'.join(LISTS)}): \[\])$", 1), F.lit("")))
    text = read("text").select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"), head.alias("own"))
    text = stage(text, "fact-lines")
    kinds = [*LISTS, *MAPS, *[f"{n}: []" for n in LISTS]]
    counted = text.groupBy("uri", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"), *[F.min(F.when(F.col("own") == k, F.col("n"))).alias(f"at{j}") for j, k in enumerate(kinds)], F.count("own").alias("heads"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counted.withColumn("before", before)
    whole = Window.partitionBy("uri")
    place = F.array_compact(F.array(*[F.when(F.col(f"p{j}").isNotNull(), F.struct(F.col(f"p{j}").alias("p"), F.lit(k).alias("head"))) for j, k in enumerate(kinds)]))
    blocks = blocks.select("uri", "block", "first", "before", F.sum("heads").over(whole).alias("heads"), *[F.min(F.col(f"at{j}") - F.col("first") + F.col("before")).over(whole).alias(f"p{j}") for j in range(len(kinds))])
    # a head that comes twice, in either form, or a file without metadata
    plain = (F.size(place) == F.col("heads")) & F.col(f"p{kinds.index('metadata')}").isNotNull()
    for n in LISTS:
        plain = plain & (F.col(f"p{kinds.index(n)}").isNull() | F.col(f"p{kinds.index(n + ': []')}").isNull())
    blocks = blocks.select("uri", "block", (F.col("before") - F.col("first")).alias("shift"), plain.alias("plain"), place.alias("heads")).join(files, "uri")
    blocks = sized(blocks, "fact-blocks")
    mine = F.array_max(F.filter("heads", lambda h: h["p"] <= F.col("n") + F.col("shift")))
    numbered = text.join(blocks.filter("plain"), ["uri", "block"]).withColumn("mine", mine).select("path", F.col("mine.head").alias("head"), (F.col("n") + F.col("shift") - F.col("mine.p") - 1).cast("int").alias("at"), "line")
    records = stage(numbered.withColumn("at", F.coalesce("at", F.lit(0))).mapInPandas(_line_rows, RECORDS), "fact-records")
    good = blocks.filter("plain").select("path").distinct().join(records.filter("kind = 'odd'").select(F.col("file").alias("path")).distinct(), "path", "left_anti")
    odd = [r["path"] for r in files.join(good.hint("merge"), "path", "left_anti").select("path").collect()]  # names, as the driver's listing has them
    if not odd:
        return records
    rest = spark.read.format("binaryFile").load([plain_path(p) for p in odd]).select("path", "content").mapInPandas(_yaml_rows, RECORDS)
    return records.join(good.select(F.col("path").alias("file")).hint("merge"), "file", "left_semi").unionByName(stage(rest, "fact-records"))


def scan_quads(spark: SparkSession, path: str) -> DataFrame:
    """A1, A2: one row a record of every ``.yaml`` or ``.yml`` file below ``path``; ``error`` marks what is in quarantine."""
    return fact_records(spark, path, recursiveFileLookup=True, pathGlobFilter="*.{yaml,yml}")


def quarantine(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    return records.filter("error IS NULL"), records.filter("error IS NOT NULL")


CONTEXT = "source_language string, file_path string, line_start int, extraction_method string, confidence double, resolved boolean, component string"


def facts_of_records(good: DataFrame) -> DataFrame:
    """Flat facts, in the order of file and place."""
    return good.filter("kind = 'fact'").withColumn("x", F.from_json("extra", CONTEXT)).select("file", "at", F.col("a").alias("subject"), F.col("b").alias("predicate"), F.col("c").alias("object"), F.coalesce("x.resolved", F.lit(True)).alias("resolved"), F.col("x.confidence").alias("confidence"), F.col("x.file_path").alias("file_path"), F.col("x.line_start").alias("line"))


def _text(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _small_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """The same, staged, of many small files: opening one counts for ``OPEN`` bytes, not for Spark's 4 MB, so that a task reads hundreds."""
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, OPEN)
    try:
        return stage(_text(spark, root, glob), "small-files")
    finally:
        spark.conf.set(key, before)


#: What the opening of a file costs, in bytes that are read meanwhile.
OPEN = 1 << 16


def scan_requirements(spark: SparkSession, root: str) -> DataFrame:
    """A3: documents with a unit; bad JSON drops out; confidence stays NULL; source_hash of the JSON with sorted keys."""
    schema = "path string, unit string, title string, requirement_backed boolean, confidence double, sections map<string,string>, section_provenance map<string,string>, feedback_ids array<long>, source_hash string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    d = json.loads(text)
                except (ValueError, RecursionError):  # broken, or nested too deep
                    continue
                if isinstance(d, dict) and d.get("unit"):
                    digest = hashlib.sha256(json.dumps(d, sort_keys=True).encode()).hexdigest()
                    as_map = lambda m: {str(k): str(x) for k, x in (m or {}).items()}
                    rows.append((path, d["unit"], d.get("title"), bool(d.get("requirement_backed", False)), d.get("confidence"), as_map(d.get("sections")), as_map(d.get("section_provenance")), d.get("feedback_ids") or [], digest))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("path s", "unit s", "title s", "requirement_backed b", "confidence d", "sections m", "section_provenance m", "feedback_ids a", "source_hash s")])

    return _small_files(spark, root, "*.json").mapInPandas(run, schema)


def scan_requirement_docs(spark: SparkSession, roots: list[str]) -> DataFrame:
    """A4: ``.json`` and ``.md`` documents, no readme; the first root wins for equal names in any case."""
    out = None
    for k, root in enumerate(roots):
        part = _small_files(spark, root, "*.{json,md}").withColumn("root", F.lit(k))
        out = part if out is None else out.unionByName(part)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return latest(out.withColumn("name", name).filter(~F.startswith("name", F.lit("readme"))), ["name"], ["root", "path"])


def scan_features(spark: SparkSession, root: str) -> DataFrame:
    """A5: (path, text) of every ``.feature`` file."""
    return _text(spark, root, "*.feature")


def read_parquet_prefix(spark: SparkSession, uri: str) -> DataFrame:
    """Every ``.parquet`` or ``.pq`` file below a prefix; Spark's error if there is none."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{parquet,pq}").parquet(uri)


def load_bindings(spark: SparkSession, root: str) -> DataFrame:
    """(token, value) of flat files; a file with no scalar is refused whole; the later file by name wins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    d = yaml.safe_load(text)
                except (yaml.YAMLError, RecursionError):  # broken, or nested too deep
                    continue
                rows += [(path, str(k), str(x)) for k, x in d.items() if isinstance(x, (str, int, float, bool))] if isinstance(d, dict) else []
            yield pd.DataFrame(rows, columns=["path", "token", "value"])

    rows = _text(spark, root, "*.{yaml,yml}").mapInPandas(run, "path string, token string, value string")
    return latest(rows, ["token"], [F.desc("path")]).select("token", "value")


def read_kb(spark: SparkSession, table: str, app: str) -> DataFrame:
    """One application's rows of a Parquet table; the filter reaches the scan.  ``database.read_kb_table`` asks a database."""
    return spark.read.parquet(table).filter(F.col("app_id") == app)


def prefer(df: DataFrame, keys: list[str], rank: str, required: DataFrame | None = None) -> DataFrame:
    """A delivered artifact (lower rank) beats a generated one of the same name.

    With ``required(keys)``, a name of which neither exists is an error.
    """
    if required is not None and (lacking := required.select(*keys).distinct().join(df.select(*keys), keys, "left_anti").limit(5).collect()):
        raise FileNotFoundError(f"neither delivered nor generated: {[tuple(r) for r in lacking]}")
    w = Window.partitionBy(*keys).orderBy(rank)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ingest_report(records: DataFrame) -> DataFrame:
    """By file: records, quarantined ones, ok or failed."""
    bad_file = F.count_if((F.col("kind") == "file") & F.col("error").isNotNull())
    return records.groupBy("file").agg(F.count_if(F.col("kind") != "file").alias("records"), F.count_if((F.col("kind") != "file") & F.col("error").isNotNull()).alias("quarantined"), F.when(bad_file > 0, "failed").otherwise("succeeded").alias("status"))


def parse_manifest(files: DataFrame) -> DataFrame:
    """Found, parsed and unparseable files by category."""
    return files.groupBy("category").agg(F.count("*").alias("found"), F.count_if("parsed").alias("parsed"), F.count_if(~F.col("parsed")).alias("unparseable"))
