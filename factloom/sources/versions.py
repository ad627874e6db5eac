"""Slices of tables that change all at once.

A slice, such as an application, is a folder of numbered versions; a version holds all
tables of the slice and counts once its marker exists, which is created last and never
replaced.  Readers take each slice's highest marked version, so they see all of its
tables old or all new, and what a failed writer left behind is never read.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocab import STATUSES

MARKER = "_COMPLETE"
#: The order in which an application's tables are written; its own row is first, for others refer to it.
APP_TABLES = ("app_applications", "param_bindings", "app_components", "app_functions", "app_endpoints", "app_tables", "app_s3_paths", "app_parameters", "app_table_relationships", "app_service_invocations", "quad_archive", "app_notes")


def _path(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> dict[str, int]:
    """The highest complete version of each slice below ``root``."""
    path, fs = _path(spark, f"{root}/slice=*/v=*/{MARKER}")
    out: dict[str, int] = {}
    for status in fs.globStatus(path) or []:
        *_, own, version, _ = status.getPath().toString().split("/")
        name, n = unquote(own.split("=", 1)[1]), int(version.split("=", 1)[1])
        out[name] = max(n, out.get(name, n))
    return out


def _folder(root: str, name: str, version: int) -> str:
    return f"{root}/slice={quote(name, safe='')}/v={version}"


def publish(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame], version: int | None = None) -> int:
    """Write all tables as a new version of the slice, then complete it.  A version that is complete already stays as it is."""
    now = current(spark, root).get(name, -1)
    if version is None:
        version = now + 1
    elif version <= now:
        return now
    folder = _folder(root, name, version)
    path, fs = _path(spark, folder)
    fs.delete(path, True)  # what a failed writer left
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}")
    fs.create(_path(spark, f"{folder}/{MARKER}")[0], False).close()
    return version


def append(spark: SparkSession, root: str, name: str, table: str, df: DataFrame) -> None:
    """Add rows to a table of the slice's current version, or begin the slice with them."""
    now = current(spark, root).get(name)
    if now is None:
        publish(spark, root, name, {table: df})
    else:
        df.write.mode("append").parquet(f"{_folder(root, name, now)}/{table}")


def read(spark: SparkSession, root: str, table: str, schema: str | None = None, names: list[str] | None = None) -> DataFrame:
    """The table over all slices (or ``names``) in their current versions; with ``schema``, empty where there is none."""
    paths = []
    for name, version in sorted(current(spark, root).items()):
        path, fs = _path(spark, f"{_folder(root, name, version)}/{table}")
        if (names is None or name in names) and fs.exists(path):
            paths.append(path.toString())
    if not paths and schema is not None:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*paths) if schema is None else spark.read.schema(schema).parquet(*paths)


def vacuum(spark: SparkSession, root: str) -> None:
    """Delete the versions below the current ones; call it when nobody reads them any more."""
    for name, version in current(spark, root).items():
        path, fs = _path(spark, f"{root}/slice={quote(name, safe='')}/v=*")
        for status in fs.globStatus(path) or []:
            if int(status.getPath().getName().split("=", 1)[1]) < version:
                fs.delete(status.getPath(), True)


def reload_app(spark: SparkSession, root: str, app: str, tables: dict[str, DataFrame]) -> int:
    """The application's tables replace its earlier ones, all or none; tables that aren't given are empty from now on.

    What people wrote (requirements, feedback, approved examples) lies elsewhere and stays.
    """
    if unknown := set(tables) - set(APP_TABLES):
        raise ValueError(f"not tables of an application: {sorted(unknown)}")
    if "app_applications" not in tables:
        raise ValueError("the application's own row is missing")
    return publish(spark, root, app, {t: tables[t].filter(F.col("app_id") == app) for t in APP_TABLES if t in tables})


# --- K2: feedback, batch by batch ------------------------------------------------

FEEDBACK = "id long, app_id string, unit string, artifact string, action string, target string, comment string, reviewer string, code_version string, status string"
COMMANDS = f"ord long, kind string, {FEEDBACK}"
_NAMES = [c.split()[0] for c in FEEDBACK.split(", ")]


def apply_commands(feedback: DataFrame, commands: DataFrame) -> DataFrame:
    """K2: ``feedback`` after ``commands(ord, kind, ...)``, with ``was``, the status before (NULL: new).

    ``add`` a record (an id that is there already is left alone; blank target, comment,
    reviewer and version are NULL), ``mark`` an id with a status, ``stale`` the open records
    of a unit.  Of a record's commands the last mark counts, and a stale behind it.
    """
    add = commands.filter("kind = 'add'")
    first = add.groupBy("id").agg(F.min_by(F.struct(*[c for c in [*_NAMES[1:], "ord"]]), "ord").alias("x")).select("id", "x.*")
    for c in ("target", "comment", "reviewer", "code_version"):
        first = first.withColumn(c, F.nullif(c, F.lit("")))
    first = first.join(feedback.select("id").hint("merge"), "id", "left_anti").withColumn("status", F.coalesce("status", F.lit("open")))
    nothing = F.lit(None).cast("string")
    rows = feedback.select(*_NAMES).withColumns({"ord": F.lit(-1).cast("long"), "was": F.col("status")}).unionByName(first.select(*_NAMES, "ord").withColumn("was", nothing))
    marks = commands.filter(F.col("kind") == "mark").filter(F.col("status").isin(*STATUSES)).groupBy("id").agg(F.max("ord").alias("marked"), F.max_by("status", "ord").alias("mark"))
    stale = commands.filter("kind = 'stale' AND unit <> ''").groupBy("app_id", "unit").agg(F.max("ord").alias("staled"))
    rows = rows.join(marks.hint("merge"), "id", "left").join(stale.hint("merge"), ["app_id", "unit"], "left")
    status, since = F.coalesce("mark", "status"), F.coalesce("marked", "ord")
    return rows.withColumn("status", F.when((status == "open") & (F.col("staled") > since), "stale").otherwise(status)).select(*_NAMES, "was")


def feedback_batch(spark: SparkSession, root: str, name: str = "feedback") -> Callable[[DataFrame, int], None]:
    """K2: for ``foreachBatch``: applies a batch of commands once, however often it is replayed.

    A batch is a version of the slice, numbered by the batch: ``feedback`` is the state after
    it and ``changed(id, was, status)`` the records that it added or moved.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        if current(spark, root).get(name, -1) >= batch_id:
            return
        after = apply_commands(read(spark, root, "feedback", FEEDBACK, [name]), batch).persist()
        try:
            moved = after.filter(~F.col("was").eqNullSafe(F.col("status"))).select("id", "was", "status")
            publish(spark, root, name, {"feedback": after.select(*_NAMES), "changed": moved}, batch_id)
        finally:
            after.unpersist()

    return put
