"""How filters interact: every order of five filters, by part of the corpus.

A table-driven transducer reads each text's UTF-8 bytes once.  Its two states say whether
the byte before belongs to a word; a (state, byte) entry gives the next state and what
to put out: a word opens or closes, a capital, a code point, a symbol.  The next state
hangs on the byte alone, so whole blocks run as array look-ups.  Opened words are spans
that go into a verified hash table (``interning``) under their text's number, which
counts distinct words.

A document then is only what its filters say (a mask of A to E), its digest and labels:

1. (id, digest, mask, part) joins the labels, one row an id;
2. equal texts meet by digest after partial aggregation: one row per (digest, part,
   labels) holds the smallest id and how many rows have it, so a group of a third of all
   rows is a few rows, and E, "a smaller id has this text", is a subtraction;
3. (part, mask) counts, at most 32 a part, are spread over the 120 orders and five steps.

Equal texts are equal SHA-256 digests and sizes.

Defined results: a null text counts as empty; a null id is no smaller than any other and
none is smaller than it; repeated rows count each, and rows that share the smallest id of
a text aren't copies of each other; a document is good or toxic where any of its label
rows says so, labels with a null id say nothing; a null part is the empty string; a part
without documents, as in an empty table, has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, documents
from .interning import chunks, intern, padded

FILTERS = "ABCDE"
OUTSIDE, INSIDE = 0, 1
OPEN, CLOSE, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16
BLANKS, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#$%&*|"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state of each byte, and output of each state and byte (state * 256 + byte)."""
    state = np.array([OUTSIDE if b in BLANKS else INSIDE for b in range(256)], np.uint16)
    put = np.zeros(512, np.uint8)
    for b in range(256):
        own = (CAPITAL if 65 <= b <= 90 else 0) | (0 if 0x80 <= b < 0xC0 else POINT) | (SYMBOL if b in SYMBOLS else 0)
        put[OUTSIDE * 256 + b] = own | (OPEN if state[b] == INSIDE else 0)
        put[INSIDE * 256 + b] = own | (CLOSE if state[b] == OUTSIDE else 0)
    return state, put


STATE, PUT = _tables()


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points and symbols of each text."""
    n, full = len(offsets) - 1, np.flatnonzero(np.diff(offsets))
    before = np.full(len(data), OUTSIDE, np.uint16)
    before[1:] = STATE[data[:-1]]
    before[offsets[full]] = OUTSIDE  # each text starts anew
    put = PUT[before << 8 | data]

    def total(flag: int) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum((put & flag) != 0)))
        return run[offsets[1:]] - run[offsets[:-1]]

    starts = np.flatnonzero(put & OPEN)
    last = offsets[full + 1]
    ends = np.sort(np.concatenate((np.flatnonzero(put & CLOSE), last[STATE[data[last - 1]] == INSIDE])))  # a text's end closes its word
    text = np.searchsorted(offsets, starts, side="right") - 1
    _, claims = intern(padded(data), starts, ends - starts, text)
    return {"words": np.bincount(text, minlength=n), "distinct": np.bincount(text[claims], minlength=n), "capitals": total(CAPITAL), "points": total(POINT), "symbols": total(SYMBOL)}


def failures(s: dict[str, np.ndarray]) -> np.ndarray:
    """Mask of the failed filters A to D of each text."""
    fails = (s["words"] < 200, 100 * s["distinct"] < 50 * s["words"], 100 * s["capitals"] > 3 * s["points"], s["symbols"] > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


MASKS = "doc_id long, part string, digest binary, mask int"
MASKS_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32())])


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest and mask of the filters A to D that the text fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offsets in chunks(b.column("text")):
                raw = memoryview(data)
                cut = offsets.tolist()
                digests = [hashlib.sha256(raw[a:z]).digest() + (z - a).to_bytes(8, "big") for a, z in zip(cut, cut[1:])]
                yield batch(MASKS_ARROW, {"doc_id": b.column("doc_id")[rows], "part": b.column("part")[rows], "digest": digests, "mask": failures(text_statistics(data, offsets))})

    part = F.coalesce(docs[part_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), part.alias("part"), docs[text_col].cast("string").alias("text")).mapInArrow(run, MASKS)


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of A to E, and the documents, good and toxic ones that have it."""
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = masks.join(flags.hint("merge"), "doc_id", "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "mask", "part", "good", "toxic"]
    ids = labelled.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))  # dealt by id already
    kinds = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    whole = F.min("first").over(Window.partitionBy("digest"))  # a digest has one row per part and labels
    firsts = F.when(F.col("first") == F.col("whole"), F.col("at_first")).otherwise(0) + F.col("no_id")
    told = kinds.withColumn("whole", whole).withColumn("firsts", firsts)
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))))
    split = told.select("part", "good", "toxic", both.alias("m")).select("part", "m.mask", "m.n", "good", "toxic").filter("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    each = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = f"shiftleft(1, instr('{FILTERS}', substring(filter_order, %s, 1)) - 1)"
    at = each.withColumn("own", F.expr(bit % "step")).withColumn("seen", F.expr(f"aggregate(sequence(1, step), 0, (m, k) -> m | {bit % 'k'})"))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("seen").bitwiseXOR(F.col("own"))) != 0

    def total(of: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")

    here = fails & ~earlier
    out = at.groupBy("part", "filter_order", "step").agg(
        total("n", F.col("mask").bitwiseAND(F.col("seen")) == 0).alias("kept"), total("n", here).alias("removed"), total("n", fails & earlier).alias("redundant"),
        total("n", F.col("mask") == F.col("own")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    )
    same = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # 120 rows
    return out.withColumn("shapley", F.sum("removed").over(same))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    return interactions(mask_counts(filter_masks(docs, id_col, text_col, part_col), labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
orders(o) AS (SELECT '' UNION ALL SELECT o || c FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(c) WHERE NOT contains(o, c)),
steps AS (
  SELECT o, s::INT AS step, 1 << (ascii(o[s]) - 65) AS own, list_sum(list_transform(range(1, s), lambda k: 1 << (ascii(o[k]) - 65)))::INT AS earlier
  FROM orders, range(1, 6) t(s) WHERE length(o) = 5),
r AS (
  SELECT part, o AS filter_order, step, chr(65 + log2(own)::INT) AS letter,
         coalesce(sum(n) FILTER (mask & (own + coalesce(earlier, 0)) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS toxic_lost
  FROM m, steps GROUP BY part, o, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""
