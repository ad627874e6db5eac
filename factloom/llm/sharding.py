"""Sharding by Hilbert-curve order.

Several metadata dimensions of a document (language, source, length, id) are quantised
to ``bits`` bits each, the cell becomes its index on the Hilbert curve, rows are sorted
by that index over the whole cluster, and the order is cut into runs.  Neighbours on
the curve are neighbours in every dimension, so each shard covers a small box of them
and a reader prunes shards by any of the dimensions (``shard_manifest``).

Law ``rows``: the counts of any two shards differ by one at most; a cell or source that
holds a third of all rows is cut like any other stretch of the order, for ties go by id
and a hash of the text.  Law ``bytes``: cuts at equal sums of sizes.

Only metadata move: the text stays where it is until ``write_shards``.

Defined results: a null text has no bytes (size 16, CRC-32 0); null metadata take the
lowest code; null ids sort first; repeated rows each get a slot of their own; with fewer
rows than shards the last shards are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_in, id_out, shuffle_width, stage

SHARDS = 40


def hilbert_index(codes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with ``bits`` bits a dimension (Skilling 2004), for whole arrays."""
    x = [c.astype(np.int64).copy() for c in codes]
    n, top = len(x), np.int64(1) << (bits - 1)
    q = top
    while q > 1:  # undo excess work from the highest bit down
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t if i else x[0]
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | ((v >> bit) & 1)
    return out


def _string_edges(df: DataFrame, col: str, bits: int) -> list[str]:
    """Up to 2**bits - 1 increasing values that cut the distinct values into equal parts."""
    n = 1 << bits
    ranges = df.select(F.col(col).alias("v")).distinct().dropna().repartitionByRange(n, "v")
    edges = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min("v").alias("v")).orderBy("v")
    return [r["v"] for r in edges.collect()][:n]  # bounded by n


def _number_edges(df: DataFrame, cols: list[str], bits: int) -> dict[str, list[float]]:
    n = 1 << bits
    at = [i / n for i in range(1, n)]
    row = df.agg(*[F.percentile_approx(c, at, 4 * n).alias(c) for c in cols]).first()
    return {c: sorted(set(row[c] or [])) for c in cols}


def hilbert_column(edges: dict[str, list], bits: int) -> Column:
    """Expects a struct of the quantised columns, in the order of ``edges``."""
    tables = [np.array(v, dtype=object if v and isinstance(v[0], str) else float) for v in edges.values()]

    @F.pandas_udf("long")
    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in parts:
            codes = []
            for name, table in zip(edges, tables):
                v = pdf[name]
                code = np.zeros(len(v), np.int64)
                if len(table) and len(v):
                    ok = v.notna().to_numpy()
                    code[ok] = np.searchsorted(table, v[ok].to_numpy(dtype=table.dtype), side="right")
                codes.append(np.minimum(code, (1 << bits) - 1))
            yield pd.Series(hilbert_index(codes, bits))

    return index(F.struct(*edges))


def assign_shards(docs: DataFrame, shards: int = SHARDS, law: str = "rows", strings: tuple[str, ...] = ("lang", "source"), bits: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert, text_hash; one row per row of ``docs``."""
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    spark, text = docs.sparkSession, F.coalesce(docs[text_col].cast("string"), F.lit(""))
    dims = [s for s in strings if s in docs.columns]
    meta = stage(docs.select(id_in(docs[id_col]).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), *[docs[s].cast("string").alias(f"s_{s}") for s in dims]), "shard-meta")
    edges: dict[str, list] = _number_edges(meta, ["size", "doc_id"], bits) | {f"s_{s}": _string_edges(meta, f"s_{s}", bits) for s in dims}
    coded = meta.withColumn("hilbert", hilbert_column(edges, bits)).select("doc_id", "size", "text_crc32", "text_hash", "hilbert")
    ordered = stage(coded.repartitionByRange(shuffle_width(spark), "hilbert", "doc_id", "text_crc32").sortWithinPartitions("hilbert", "doc_id", "text_crc32").withColumn("at", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("at", 33)
    parts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    rows = sorted((r["part"], r["n"], r["bytes"]) for r in parts.collect())  # one row a partition
    before = np.cumsum([0] + [n for _, n, _ in rows]).tolist()
    starts = spark.createDataFrame([(p[0], b) for p, b in zip(rows, before)], "part long, before long")  # one row a partition
    ranked = ordered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).drop("part", "before")
    total = before[-1]
    if law == "rows":
        base, more = divmod(total, shards)
        cut = more * (base + 1)
        rank = F.col("rank")
        shard = F.when(rank < cut, F.floor(rank / (base + 1))).otherwise(more + F.floor((rank - cut) / max(base, 1)))
        slot = F.when(rank < cut, rank % (base + 1)).otherwise((rank - cut) % max(base, 1))
        out = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))
    else:
        out = _cut_by_bytes(ordered, ranked, rows, shards)
    return out.select(id_out("doc_id").alias("doc_id"), "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", "text_hash")


def _cut_by_bytes(ordered: DataFrame, ranked: DataFrame, rows: list, shards: int) -> DataFrame:
    """Shard by the sum of sizes up to a row's middle; sums run inside each sorted partition."""
    before, total = {}, 0
    for p, _, size in rows:
        before[p], total = total, total + size

    def sums(batches):
        seen: dict[int, int] = {}
        for pdf in batches:
            at = pdf["at"].to_numpy() >> 33
            up = np.zeros(len(pdf), np.int64)
            for p in np.unique(at):
                own = at == p
                run = pdf["size"].to_numpy()[own].cumsum()
                up[own] = before[int(p)] + seen.get(int(p), 0) + run
                seen[int(p)] = seen.get(int(p), 0) + int(run[-1])
            middle = up - pdf["size"].to_numpy() / 2
            yield pdf.assign(shard=np.minimum(middle * shards // max(total, 1), shards - 1).astype(np.int32))

    # a task may read several sorted partitions, each whole and in order
    schema = ", ".join(f"{n} {t}" for n, t in ranked.dtypes)
    cut = stage(ranked.sortWithinPartitions("at").mapInPandas(sums, schema + ", shard int"), "shard-cut")
    firsts = {r["shard"]: r["rank"] for r in cut.groupBy("shard").agg(F.min("rank").alias("rank")).collect()}
    starts = F.create_map(*[F.lit(x) for kv in firsts.items() for x in kv]) if firsts else F.create_map(F.lit(0), F.lit(0))
    return cut.withColumn("slot", F.col("rank") - starts[F.col("shard")])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write whole documents by shard, sorted by slot; returns the manifest that readers prune by.

    Rows that repeat id and text take their places in the order of a hash of all columns.
    Columns of ``docs`` named ``shard`` or ``slot`` give way to ours.
    """
    spark, columns = docs.sparkSession, [c for c in docs.columns if c not in ("shard", "slot")]
    key = ["_id", "_hash"]
    own = assign_shards(docs, shards, id_col=id_col, text_col=text_col).select(id_in("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "shard", "slot")
    own = stage(own.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot"))), "shard-places")
    again = own.filter("_n = 2").select(*key)
    rows = docs.select(*[docs[c] for c in columns], id_in(docs[id_col]).alias("_id"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("_hash"))
    placed = rows.join(own.join(again.hint("merge"), key, "left_anti").hint("shuffle_hash"), key)
    if not again.isEmpty():
        order = Window.partitionBy(*key).orderBy(F.xxhash64(F.to_json(F.struct(*columns))))
        several = rows.join(again.hint("shuffle_hash"), key, "left_semi").withColumn("_n", F.row_number().over(order))
        placed = placed.drop("_n").unionByName(several.join(own.hint("merge"), [*key, "_n"]).drop("_n"))
    placed = placed.select(*columns, "shard", "slot")
    placed.repartitionByRange(shuffle_width(spark), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return shard_manifest(spark.read.parquet(path))


def shard_manifest(written: DataFrame) -> DataFrame:
    """Rows and the smallest and largest value of each plain column of a shard."""
    plain = [n for n, t in written.dtypes if n not in ("shard", "slot", "text") and t.split("(")[0] in ("bigint", "int", "string", "double", "date", "timestamp")]
    return written.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{k}_{c}") for c in plain for k, f in (("min", F.min), ("max", F.max))])


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir)).drop("text_hash")
