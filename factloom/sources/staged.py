"""Tables that cut lineage: Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own, which only a local session can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-factloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return "/".join([base.rstrip("/"), "factloom", spark.sparkContext.applicationId, *_scopes])


#: Folders below the application's that tables are staged in at the moment, outermost first.
_scopes: list[str] = []


@contextmanager
def own_folder(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside the block lie in a folder of their own, which is given; ``drop_folder`` deletes it once what reads them is written."""
    _scopes.append(f"part-{uuid.uuid4().hex}")
    try:
        yield shared_dir(spark)
    finally:
        _scopes.pop()


def drop_folder(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write and read back, for as long as the application runs or until ``drop_staged``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete this application's staged tables; call it once the results that read them are written."""
    drop_folder(spark, shared_dir(spark))


#: Rows of a table that is sent to every task, some 10 MB of ids and names.
SMALL = 100_000


def sized(df: DataFrame, name: str) -> DataFrame:
    """A staged table, hinted by its counted rows: sent to every task up to ``SMALL``, else joined by sorting both sides."""
    out = stage(df, name)
    return out.hint("broadcast" if out.count() <= SMALL else "merge")
