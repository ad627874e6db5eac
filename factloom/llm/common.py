"""Shared helpers: the shared folder, staged tables, and null-safe ids.

Staged tables are Parquet in the folder that all executors share
(``spark.checkpoint.dir``).  They cut lineage, give the planner true sizes, and
survive the loss of an executor.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staged import shared_dir, stage  # noqa: F401  operators take it from here

#: Stands for a null id inside operators; it turns back into null on output.
NULL_ID = -(2**63)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Caches of a worker process, which may serve one operator after another.
_caches: dict[str, object] = {}


def own_cache(owner: str, cache: dict) -> None:
    """Called where a task starts: keeps this operator's cache and empties those of the others."""
    _caches[owner] = cache
    for name, other in _caches.items():
        if name != owner:
            other.clear()


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: hand few of them to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def id_in(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def id_out(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != NULL_ID, c)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``kept(doc_id, text_hash, again)`` names, with the columns of ``docs`` only.

    ``again``: rows of ``docs`` repeat this id and text and one of them stays, the first by a hash of all columns.
    """
    wanted = stage(kept.select(id_in("doc_id").alias("_keep_id"), F.col("text_hash").alias("_keep_hash"), F.col("again").alias("_again")), "kept-rows")
    own, text = id_in(docs[id_col]), F.xxhash64(docs[text_col].cast("string"))

    def those(ids: DataFrame) -> DataFrame:
        return docs.join(ids.hint("shuffle_hash"), (own == ids["_keep_id"]) & (text == ids["_keep_hash"]), "left_semi")

    out = those(wanted.filter("not _again")).select(*[docs[c] for c in docs.columns])
    again = wanted.filter("_again")
    if again.isEmpty():
        return out
    whole = F.struct(*[docs[c] for c in docs.columns])
    one = those(again).groupBy(own, text).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("_row")).select("_row.*")
    return out.unionByName(one)


#: Largest bit map that marks wanted keys, 8 MB; beyond its capacity only more rows pass.
MARK_BITS = 26


def marker(wanted: DataFrame, keys: list[str]):
    """A filter for rows whose keys may be in ``wanted``; call the result with the columns that hold the keys.

    It only thins rows out before an exact join, so false positives don't matter.
    """
    shared, bits = marks(wanted, keys)

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        return pd.Series(is_marked(shared.value, at.to_numpy()))

    return lambda *cols: marked(spot(cols, bits))


def spot(cols, bits: int) -> Column:
    """Place of a row's keys in a bit map."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << bits))


def is_marked(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1


def marks(wanted: DataFrame, keys: list[str]):
    """Broadcast bit map of the keys of a staged table, and the logarithm of its bits: 16 to 32 bits a key up to ``MARK_BITS``."""
    bits = min(MARK_BITS, max(16, wanted.count().bit_length() + 4))
    at = spot(keys, bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(31)).cast("int"))
    table = wanted.groupBy(F.shiftright(at, 5).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 5), np.uint32)
    words[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)
    return wanted.sparkSession.sparkContext.broadcast(words), bits


def ranks(df: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """``df`` with each row's place (from 1) as ``rank`` in the whole order, and the number of rows.

    Rows are sorted by ranges, and one number a range reaches the driver.  ``df`` should be a staged table.
    """
    spark = df.sparkSession
    ordered = stage(df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = sorted(tuple(r) for r in ordered.groupBy(part).agg(F.count("*")).collect())
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part long, _before long")  # one row a range
    place = (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).alias("rank")
    return ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*df.columns, place), before[-1]
