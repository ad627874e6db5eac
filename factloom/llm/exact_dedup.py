"""Exact deduplication by a tree-merge of sorted digest runs.

1. Each partition turns its texts into a run: entries ``(key, best id, count)`` sorted
   by key, cut by the leading digest bits into buckets.  The key is the SHA-256 of the
   normalised text followed by a second, independent 64-bit hash and so verifies each
   match: texts count as equal only if both agree.  Equal texts of one partition
   collapse here, so a group that holds a third of all rows is one entry a run.
2. In binomial rounds, ``fan`` neighbouring runs of a bucket meet in one task, which
   merges them and keeps the best verified id and the summed count of each key.
   Round r leaves R / fan**r runs; a task holds at most ``fan`` runs of one bucket.
3. The last run of a bucket is looked up by that bucket's first runs, which gives rows
   ``(run, key) -> (keep id, size)`` for repeated texts only.  Documents take their
   decision by ``(run, key)``, which spreads even a very large group over all runs.

No text is shuffled: about 60 bytes a document move.

Defined results: a null text counts as empty; empty texts are equal to each other;
null ids sort below all others and stay null; rows that repeat an id are each reported;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, id_in, id_out, keep_rows, shuffle_width, small_batches, stage, text_bytes

KEY = 40
MAPPED = "kind int, doc_id long, hash long, run long, bucket int, key binary, ids binary, counts binary"
ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("run", pa.int64()), ("bucket", pa.int32()), ("key", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
#: Entries of one run before a partition starts another.
RUN_ROWS = 1 << 20
#: Run numbers of a partition start at its number times this; a partition never has as many runs.
STRIDE = 1 << 20


def text_key(text: bytes) -> bytes:
    """SHA-256 of the text with A-Z lowered, and a second hash that verifies it."""
    text = text.lower()
    return hashlib.sha256(text).digest() + xxhash.xxh64_digest(text, seed=len(text))


def collapse(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, keep: str):
    """Merge by key (a stable sort, which merges runs that are sorted already) and keep the best id and the sum of each key."""
    if not len(keys):
        return keys, ids, counts
    order = np.argsort(keys, kind="stable")
    keys, ids, counts = keys[order], ids[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    best = np.maximum if keep == "max" else np.minimum
    return keys[first], best.reduceat(ids, first), np.add.reduceat(counts, first)


def _runs(buckets: int, keep: str):
    shift = 32 - (buckets.bit_length() - 1)

    def blobs(run: int, keys: list[bytes], ids: list[int]) -> Iterator[pa.RecordBatch]:
        k, i, c = collapse(np.array(keys, dtype=f"S{KEY}"), np.array(ids, np.int64), np.ones(len(keys), np.int64), keep)
        raw = k.view(np.uint8).reshape(len(k), KEY)
        lead = (raw[:, :4].astype(np.uint64) << np.array([24, 16, 8, 0], np.uint64)).sum(axis=1) >> np.uint64(shift)
        edges = np.flatnonzero(np.concatenate(([True], lead[1:] != lead[:-1], [True])))
        cut = [(int(lead[a]), raw[a:b].tobytes(), i[a:b].tobytes(), c[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
        n = len(cut)
        yield batch(ARROW, {"kind": [1] * n, "doc_id": [None] * n, "hash": [None] * n, "run": [run] * n, "bucket": [x[0] for x in cut], "key": [x[1] for x in cut], "ids": [x[2] for x in cut], "counts": [x[3] for x in cut]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[bytes] = []
        ids: list[int] = []
        for b in batches:
            own, its = [text_key(t) for t in text_bytes(b.column("text"))], b.column("doc_id").to_pylist()
            at, n = part * STRIDE + seq, len(own)
            yield batch(ARROW, {"kind": [0] * n, "doc_id": its, "hash": b.column("hash"), "run": [at] * n, "bucket": [None] * n, "key": own, "ids": [None] * n, "counts": [None] * n})
            keys += own
            ids += its
            if len(keys) >= RUN_ROWS:
                yield from blobs(at, keys, ids)
                keys, ids, seq = [], [], seq + 1
        if keys:
            yield from blobs(part * STRIDE + seq, keys, ids)

    return run


def _unpack(pdf: pd.DataFrame):
    keys = np.frombuffer(b"".join(pdf["key"]), dtype=f"S{KEY}")
    return keys, np.frombuffer(b"".join(pdf["ids"]), np.int64), np.frombuffer(b"".join(pdf["counts"]), np.int64)


def _merge(keep: str):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        k, i, c = collapse(*_unpack(pdf.sort_values("run")), keep)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "run": [int(pdf["up"].iloc[0])], "key": [k.tobytes()], "ids": [i.tobytes()], "counts": [c.tobytes()]})

    return merge


def _descend(first: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
    """What the merged run of a bucket says about each repeated key of its first runs."""
    k, i, c = _unpack(last)
    out = []
    for run, keys in zip(first["run"], first["key"]):
        own = np.frombuffer(keys, dtype=f"S{KEY}")
        at = np.searchsorted(k, own)
        many = c[at] > 1
        raw = own[many].view(np.uint8).reshape(-1, KEY)
        out.append(pd.DataFrame({"run": np.int64(run), "key": [x.tobytes() for x in raw], "keep_id": i[at][many], "group_size": c[at][many]}))
    return pd.concat(out) if out else pd.DataFrame({"run": [], "key": [], "keep_id": [], "group_size": []})


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan: int = 8, buckets: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash: one row per row of ``docs``.

    ``keep`` says which id of equal texts stays ("min" or "max").  ``buckets`` (a power
    of two) bounds what one merge task holds; by default it follows the shuffle width.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = buckets or 1 << min(20, max(2, (shuffle_width(spark) - 1).bit_length()))
    mapped = stage(docs.select(id_in(docs[id_col]).alias("doc_id"), docs[text_col].cast("string").alias("text"), F.xxhash64(docs[text_col].cast("string")).alias("hash")).mapInArrow(_runs(buckets, keep), MAPPED), "digest-runs")
    entries = mapped.filter("kind = 0").select("doc_id", "hash", "run", "key")
    first = mapped.filter("kind = 1").select("bucket", "run", "key", "ids", "counts")
    top = first.agg(F.max(F.col("run")).alias("run")).first()["run"]
    runs, step, left = first, STRIDE, (top or 0) // STRIDE + 1  # the first round joins the runs of one partition
    while True:
        up = runs.withColumn("up", F.floor(F.col("run") / step).cast("long"))
        runs = up.groupBy("bucket", "up").applyInPandas(_merge(keep), "bucket int, run long, key binary, ids binary, counts binary")
        if left <= 1:
            break
        step, left = fan, -(-left // fan)
    known = first.select("bucket", "run", "key").groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInPandas(_descend, "run long, key binary, keep_id long, group_size long")
    out = entries.join(known.hint("merge"), ["run", "key"], "left")
    keep_id = F.coalesce("keep_id", "doc_id")
    return out.select(
        id_out("doc_id").alias("doc_id"), id_out(keep_id).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (keep_id == F.col("doc_id")).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"), F.col("hash").alias("text_hash"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the rows that an equal text with a better id makes redundant: one row of each group stays.

    Of rows that share that id, the first by the hash of the text before lowering stays.
    """
    kept = exact_groups(docs, id_col, text_col, keep).filter("kept")
    one = kept.groupBy("text_sha256").agg(F.min(F.struct("text_hash", "doc_id")).alias("best"), (F.count("*") > 1).alias("again"))
    return keep_rows(docs, one.select("best.doc_id", "best.text_hash", "again"), id_col, text_col)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).drop("text_hash")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
