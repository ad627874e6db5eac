"""Sinks: clean slices, upserts, graph files, reports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import latest
from .staged import stage


def replace_app_slice(df: DataFrame, path: str) -> None:
    """The applications in ``df`` replace their own partitions; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("app_id").parquet(path)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A10: existing rows first; of new ones with an equal key the first in order."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return latest(both, keys, ["_src", order]).drop("_src")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str, mode: str = "upsert") -> DataFrame:
    """The last row of a key wins; mode ``replace`` drops the other rows of the new rows' applications."""
    if mode == "replace":
        existing = existing.join(new.select("app_id").distinct(), "app_id", "left_anti")
    both = existing.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return latest(both, keys, [F.desc("_src"), F.desc(order)]).drop("_src")


def property_keys(df: DataFrame, order: Sequence[str]) -> list[str]:
    """Keys of the ``properties`` maps, by the first row in ``order`` that has them and their place there."""
    at = df.select(F.struct(*order).alias("row"), F.posexplode(F.map_keys("properties")).alias("k", "key"))
    firsts = at.groupBy("key").agg(F.min(F.struct("row", "k")).alias("first")).orderBy("first", "key")
    return [r["key"] for r in firsts.select("key").collect()]  # one row a kind of property


def write_graph_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Bulk-load files by application: ``~id``, ``~label``, ``name:String`` or ``~id``, ``~from``, ``~to``, ``~label``,
    then a column for every property that any row has.

    The first pass finds the columns, so that all files have one header; what a row lacks is empty.
    """

    def put(df: DataFrame, fixed: dict[str, str], order: Sequence[str], name: str) -> None:
        keys = property_keys(df, order)
        plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in fixed.items()]
        rest = [F.coalesce(F.try_element_at("properties", F.lit(k)), F.lit("")).alias(f"{k}:String") for k in keys]
        df.select(*plain, *rest, "app_id").write.mode("overwrite").partitionBy("app_id").options(header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/{name}")

    put(nodes, {"~id": "id", "~label": "label", "name:String": "name"}, ("rank", "id"), "nodes")
    put(edges, {"~id": "id", "~from": "src", "~to": "dst", "~label": "label"}, ("id",), "edges")


def _files(path: str):
    """File system of a path as Hadoop qualifies it, and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if path.startswith("file:") else fs.FileSystem.from_uri(path)


def _write_names(aside: str):
    """Writes rows (name, line) that come name by name below ``aside``; gives each name with what its file is called there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(aside)
        attempt, at, out = uuid.uuid4().hex, None, None
        for b in batches:
            names, lines, made = b.column("name").to_pylist(), b.column("line").to_pylist(), []
            for name, own in groupby(range(len(names)), names.__getitem__):
                if name != at or out is None:
                    if out is not None:
                        out.close()
                    at, part = name, uuid.uuid4().hex
                    out = files.open_output_stream(f"{root}/{attempt}-{part}", compression=None)
                    made.append((name, f"{attempt}-{part}", re.sub(r"[^\w.-]+", "_", name)))
                out.write("".join(f"{lines[k] or ''}\n" for k in own).encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made)], ["name", "part", "file"])
        if out is not None:
            out.close()

    return run


def _move(aside: str, target: str, extension: str):
    """Moves files to their names, over earlier ones; one that a task before this one moved already stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, source), (_, root) = _files(aside), _files(target)
        for b in batches:
            for part, file in zip(b.column("part").to_pylist(), b.column("file").to_pylist()):
                start, to, sums = files.get_file_info([f"{source}/{part}", f"{root}/{file}{extension}", f"{root}/.{file}{extension}.crc"])
                if not start.is_file and to.is_file:
                    continue
                if sums.is_file:  # of an earlier file
                    files.delete_file(sums.path)
                if to.is_file and files.type_name != "local":
                    files.delete_file(to.path)
                files.move(start.path, to.path)
            yield b.select(["file"])

    return run


def put_files(rows: DataFrame, path: str, extension: str) -> DataFrame:
    """One text file a name of ``rows(name, pos, line)``, lines in order of ``pos``; returns ``file``, their names without ``extension``.

    Tasks write below a folder beside ``path`` first, so a failed one leaves no file; then
    tasks move the files to their names, over earlier ones.  The driver sees neither.  Names that
    are alike but for signs that a file can't have are refused before any is moved.  A file
    goes through one task, line by line, by ``pyarrow.fs``: files of Spark's own writer are
    committed and moved one by one on the driver.  Rows are dealt by a hash of the name: a
    shuffle on the name itself is left out where all parts of a union are dealt by it, and
    the parts then stay apart.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root, target = jvm.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}"), jvm.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.mkdirs(root)
    aside, to = fs.makeQualified(root).toString(), fs.makeQualified(target).toString()
    name = F.coalesce(F.nullif(F.col("name").cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    dealt = rows.withColumn("name", name).withColumn("_hash", F.xxhash64("name")).repartition("_hash").sortWithinPartitions("name", "pos")
    try:
        made = stage(dealt.select("name", "line").mapInArrow(_write_names(aside), "name string, part string, file string"), "written-files")
        twice = made.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1").orderBy("file").limit(5)
        if shared := [r["file"] for r in twice.collect()]:
            raise OSError(f"names that would share a file: {shared}")
        return stage(made.mapInArrow(_move(aside, to, extension), "file string"), "moved-files")
    finally:
        fs.delete(root, True)


def write_files(rows: DataFrame, path: str, extension: str) -> list[str]:
    """``put_files`` for some names: returns the paths."""
    target = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toString()
    return sorted(f"{target}/{r['file']}{extension}" for r in put_files(rows, path, extension).collect())


_CONTEXT = "named_struct('source_language', language, 'file_path', file_path, 'line_start', line, 'extraction_method', extraction_method, 'confidence', confidence, 'resolved', resolved)"


def write_quads(facts: DataFrame, metadata: DataFrame, path: str, entities: DataFrame | None = None, notes: DataFrame | None = None, bindings: DataFrame | None = None) -> list[str]:
    """One fact file an application of ``metadata(app_id, metadata map)``, which ``readers.scan_quads`` reads back.

    ``facts(app_id, ord, subject, predicate, object, language, file_path, line,
    extraction_method, confidence, resolved)``, ``entities(app_id, id, type, name, language,
    file_path, line_start, line_end)``, ``notes(app_id, ord, text, subject, file_path, line,
    provenance)``, ``bindings(app_id, token, value)``.  Files are YAML: a section a line, its
    entries as JSON, which YAML includes, so that none is held whole.
    """
    keep = {"ignoreNullFields": "false"}
    entry = lambda struct: F.concat(F.lit("- "), F.to_json(struct, keep))
    none = F.lit(None)
    parts = [metadata.select("app_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.lit("").alias("key"), F.concat(F.lit("metadata: "), F.to_json(F.map_concat(F.col("metadata"), F.create_map(F.lit("app_id"), F.col("app_id"))), keep)).alias("line"))]
    counts = metadata.select("app_id")
    sections = {"entities": (entities, lambda: F.struct("id", "type", "name", "language", F.struct("file_path", "line_start", "line_end").alias("source")), "id"), "quads": (facts, lambda: F.struct("subject", "predicate", "object", F.col("predicate").alias("relationship_type"), F.expr(_CONTEXT).alias("context")), "ord"), "notes": (notes, lambda: F.struct("text", "subject", "file_path", "line", "provenance"), "ord")}
    total = F.lit("")
    for k, (name, (df, struct, order)) in enumerate(sections.items(), 2):
        single = {"entities": "entity_count", "quads": "quad_count", "notes": "note_count"}[name]
        if df is None:
            parts.append(metadata.select("app_id", F.lit(k).alias("part"), F.lit(-1).cast("long").alias("n"), F.lit("").alias("key"), F.lit(f"{name}: []").alias("line")))
            total = F.concat(total, F.lit(f', "{single}": 0'))
            continue
        n = df.groupBy("app_id").agg(F.count("*").alias(single))
        counts = counts.join(n.hint("merge"), "app_id", "left").withColumn(single, F.coalesce(single, F.lit(0).cast("long")))
        total = F.concat(total, F.lit(f', "{single}": '), F.col(single).cast("string"))
        head = F.when(F.col(single) > 0, f"{name}:").otherwise(f"{name}: []")
        parts.append(counts.select("app_id", F.lit(k).alias("part"), F.lit(-1).cast("long").alias("n"), F.lit("").alias("key"), head.alias("line")))
        n, key = (F.col("ord").cast("long"), F.lit("")) if order == "ord" else (F.lit(0).cast("long"), F.col("id"))
        parts.append(df.join(metadata.select("app_id").hint("merge"), "app_id", "left_semi").select("app_id", F.lit(k).alias("part"), n.alias("n"), key.alias("key"), entry(struct()).alias("line")))
    parts.append(counts.select("app_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), F.lit("").alias("key"), F.concat(F.lit("summary: {"), F.substr(total, F.lit(3)), F.lit("}")).alias("line")))
    held = metadata.select("app_id", none.cast("map<string,string>").alias("b")) if bindings is None else metadata.select("app_id").join(bindings.groupBy("app_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "value")))).alias("b")).hint("merge"), "app_id", "left")
    parts.append(held.select("app_id", F.lit(9).alias("part"), F.lit(0).cast("long").alias("n"), F.lit("").alias("key"), F.concat(F.lit("bindings: "), F.coalesce(F.to_json("b"), F.lit("{}"))).alias("line")))
    rows = reduce(DataFrame.unionByName, parts)
    return write_files(rows.select(F.col("app_id").alias("name"), F.struct("part", "n", "key").alias("pos"), "line"), path, "_quads.yaml")


def write_documents(markdown: DataFrame, path: str) -> list[str]:
    """One Markdown file a unit of ``markdown(unit, markdown)``."""
    return write_files(markdown.select(F.col("unit").alias("name"), F.lit(0).alias("pos"), F.rtrim("markdown", F.lit("\n")).alias("line")), path, ".md")


def write_report(df: DataFrame, path: str) -> None:
    """A15"""
    df.write.mode("overwrite").json(path)
