"""Importance resampling towards a target distribution.

1. Words of a block of texts are compacted to one blank between two; every run of 1 to
   ``max_n`` words is a span of that buffer, a feature.  An open-addressed table interns
   the spans (``interning``): a slot is one distinct feature and stores its bucket
   (CRC-32 of its bytes) and its count, so each distinct feature is hashed to its bucket
   once a block.  Tasks add slot counts by bucket; Spark sums them.
2. Gains of the buckets, ``buckets`` numbers, go to the tasks, which intern again and
   gather each occurrence's gain by its slot; a document's weight is their floored mean.
3. Weight plus Gumbel noise from the hash of the id is the score.  The best are drawn
   without replacement: rows are sorted by ranges of (score, id) over the cluster, and a
   row's rank is its place in its range plus the sizes of the ranges before.

What reaches the driver: ``buckets`` counts, and one number a range.

Defined results: null texts have no feature; without features the weight is 0; a null id
takes part as the text ``null`` in the noise and sorts first in ties; repeated rows are
scored alike and drawn each on their own; documents of fewer than ``least`` words are
never drawn; an empty target makes all gains follow the documents alone; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, id_in, id_out, ranks, stage
from .interning import BLOCK, chunks, intern, padded

BUCKETS = 10_000
SEED = 2024
BLANK = 32
#: A-Z become a-z; digits, letters and all bytes of other characters are words, the rest blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else BLANK for b in range(256))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compacted buffer, starts and ends of its words, and the text of each word."""
    buf = np.frombuffer(data.tobytes().translate(FOLD), np.uint8)
    inside = buf != BLANK
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))  # words don't go on from one text to the next
    first, last = offsets[full], offsets[full + 1] - 1
    opens[first], closes[last] = inside[first], inside[last]
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    ends = np.cumsum(closes - opens + 1) - 1
    joined = np.insert(buf[inside], np.cumsum(closes - opens), BLANK)
    return padded(joined), ends - (closes - opens), ends, np.searchsorted(offsets, opens, side="right") - 1


def features(data: np.ndarray, offsets: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of words, buffer, starts, sizes and texts of the features, ``BLOCK`` of them at a time."""
    buf, starts, ends, text = words(data, offsets)
    for n in range(1, max_n + 1):
        own = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1]) if len(text) >= n else np.zeros(0, np.int64)
        for k in range(0, len(own), BLOCK):
            at = own[k : k + BLOCK]
            yield n, buf, starts[at], ends[at + n - 1] - starts[at], text[at]


def slot_buckets(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each feature and bucket of each slot."""
    slots, claims = intern(buf, starts, sizes)
    raw = memoryview(buf)
    at = zip(starts[claims].tolist(), sizes[claims].tolist())
    return slots, np.fromiter((zlib.crc32(raw[s : s + n]) % buckets for s, n in at), np.int64, len(claims))


def _texts(docs: DataFrame, text_col: str, *cols) -> DataFrame:
    return docs.select(*cols, docs[text_col].cast("string").alias("text"))


COUNTED = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, max_n: int = 1, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, data, offsets in chunks(b.column("text")):
                for _, buf, starts, sizes, _ in features(data, offsets, max_n):
                    slots, bucket = slot_buckets(buf, starts, sizes, buckets)
                    np.add.at(total, bucket, np.bincount(slots, minlength=len(bucket)))
        at = np.flatnonzero(total)
        yield batch(COUNTED, {"bucket": at.astype(np.int32), "n": total[at]})

    counted = _texts(docs, text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # bounded by ``buckets``
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the ratio of smoothed shares, floored."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


WEIGHTED = "doc_id long, n_words long, n_features long, weight long, score long"
WEIGHTED_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_features", "weight", "score")])


def weigh(docs: DataFrame, gains: np.ndarray, max_n: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for rows, data, offsets in chunks(b.column("text")):
                n_words, n, total = (np.zeros(len(offsets) - 1, np.int64) for _ in range(3))
                for k, buf, starts, sizes, text in features(data, offsets, max_n):
                    slots, bucket = slot_buckets(buf, starts, sizes, len(gains))
                    edge = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))  # features go by text
                    own = np.diff(np.append(edge, len(text)))
                    n[text[edge]] += own
                    total[text[edge]] += np.add.reduceat(gains[bucket][slots], edge)
                    if k == 1:
                        n_words[text[edge]] += own
                weight = total // np.maximum(n, 1)
                score = weight + np.array([noise(i, seed) for i in ids[rows]], np.int64)
                yield batch(WEIGHTED_ARROW, {"doc_id": ids[rows], "n_words": n_words, "n_features": n, "weight": weight, "score": score})

    return _texts(docs, text_col, docs[id_col].cast("long").alias("doc_id")).mapInArrow(run, WEIGHTED)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, buckets: int = BUCKETS, max_n: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank; the rank is null where a document isn't drawn."""
    gains = bucket_gains(bucket_counts(docs, buckets, max_n, text_col), bucket_counts(target, buckets, max_n, target_col))
    scored = stage(weigh(docs, gains, max_n, seed, id_col, text_col).withColumn("doc_id", id_in("doc_id")), "resample-scores")
    may = scored.filter(F.col("n_words") >= least)
    ranked, total = ranks(may, F.desc("score"), F.asc("doc_id"))
    rank = F.when(F.col("rank") <= percent * total // 100, F.col("rank")).cast("long")
    out = ranked.withColumn("rank", rank).unionByName(scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
    return out.select(id_out("doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


_OP13_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 by bytes (hex digits of a distinct word), its table by eight steps a value.
OP13_SQL = f"""
WITH RECURSIVE step(v, k, c) AS (
  SELECT v::BIGINT, 0, v::BIGINT FROM range(256) t(v)
  UNION ALL
  SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS tab FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_OP13_WORDS} AS w FROM documents),
used AS (SELECT w, count(*) AS n, false AS target FROM (SELECT unnest(w) AS w FROM d) GROUP BY w
         UNION ALL
         SELECT w, count(*), true FROM (SELECT unnest({_OP13_WORDS}) AS w FROM benchmark) GROUP BY w),
hexed AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM used)),
bucketed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: (16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
               lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t FROM used JOIN bucketed USING (w) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums),
weights AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM (SELECT r, unnest(w) AS w FROM d) JOIN bucketed USING (w) JOIN gains USING (bucket) GROUP BY r),
noisy AS (SELECT r, list_reduce(list_prepend(0::BIGINT, list_transform(range(8), lambda i: (instr('0123456789abcdef', h[i + 1]) - 1)::BIGINT)), lambda a, b: a * 16 + b) AS h
          FROM (SELECT r, sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM d)),
scored AS (
  SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d JOIN noisy USING (r) LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM placed
UNION ALL
SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
