"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Score = logistic(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j).  The pair term takes
linear time by the sum-of-squares identity: half of sum_f (sum v_if x_i)^2 - sum (v_if x_i)^2.

Inputs: hashed lower-case words (tf, scaled to length 1), shape figures of the text (shares
of character classes, repeated lines and words, word and line lengths, doubled marks) and
the stated length, each cut into bins.  Labels, language, source and id are never inputs.

The model is fitted on a bounded sample: the ``max_train`` labelled rows with the smallest
hash of their id, whole texts.  Every row is scored.

Defined results: null and empty texts have the empty features and get a score as well;
a text of any length is read whole; a label that is null or neither 0 nor 1 is ignored, of
repeated labels the largest counts; without both kinds of label every score is 0.5;
each row, repeated or with a null id, gets its own result; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, own_cache, small_batches, text_bytes

WORD_BITS = 14
WORDS = 1 << WORD_BITS
BINS = 16
STATS = ("empty", "chars", "words", "lower", "upper", "digit", "blank", "line", "mark", "symbol", "other", "repeated_lines", "distinct_words", "word_length", "line_length", "doubled", "stated")
SIZE = WORDS + len(STATS) * BINS
RANK = 8
MAX_TRAIN = 8000
#: Characters that one pass of the feature code holds.
CHUNK = 1 << 20

#: Byte classes: lower, upper, digit, blank, line break, common marks, symbols, not ASCII.
_CLASS = np.full(256, 6, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:'\"-()?")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 7


class _WordBins(dict):
    """Hashed bins of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = k = zlib.crc32(word) & (WORDS - 1)
        return k


_bins = _WordBins()


def _stat_bins(text: bytes, words: list[bytes], stated: int | None) -> list[int]:
    n = max(len(text), 1)
    shares = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8) / n
    lines = text.split(b"\n")
    many = max(len(words), 1)
    log = lambda v: min(BINS - 1, int(np.log2(v + 1)))
    part = lambda v: min(BINS - 1, int(np.sqrt(min(max(v, 0.0), 1.0)) * BINS))
    doubled = sum(text.count(x) for x in (b"!!", b"??", b"$$", b"##", b"%%", b"&&", b"**", b"||"))
    return [
        0 if text.strip() else 1, log(len(text)), log(len(words)), *[part(s) for s in shares], part(1 - len(set(lines)) / len(lines)),
        part(len(set(words)) / many), log(len(text) / many * 2), log(len(text) / len(lines)), part(doubled / many), BINS - 1 if stated is None else log(max(stated, 0)),
    ]


def features(texts: list[bytes], stated: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, feature ids and values; each row has its bins of statistics, so none is empty."""
    own_cache("quality", _bins)
    hashed, counts, stats = [], [], []
    for text, n in zip(texts, stated):
        words = text.lower().split()
        hashed.append(np.fromiter(map(_bins.__getitem__, words), np.int64, len(words)))
        counts.append(len(words))
        stats.append(_stat_bins(text, words, n))
    rows = np.repeat(np.arange(len(texts)), counts)
    keys, tf = np.unique(rows * WORDS + (np.concatenate(hashed) if hashed else np.zeros(0, np.int64)), return_counts=True)
    who, word = keys // WORDS, keys % WORDS
    value = np.log1p(tf).astype(np.float32)
    norm = np.sqrt(np.bincount(who, value * value, minlength=len(texts)))
    value /= norm[who].astype(np.float32)
    fixed = np.array(stats, np.int64).reshape(len(texts), len(STATS)) + WORDS + np.arange(len(STATS)) * BINS
    who = np.concatenate((np.repeat(np.arange(len(texts)), len(STATS)), who))
    ids = np.concatenate((fixed.reshape(-1), word))
    value = np.concatenate((np.full(fixed.size, 1 / np.sqrt(len(STATS)), np.float32), value))
    order = np.argsort(who, kind="stable")
    starts = np.searchsorted(who[order], np.arange(len(texts)))
    return starts, ids[order], value[order]


class Machine:
    """w0, w and V; a fixed number of floats, whatever the corpus."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.w0 = np.zeros(1, np.float32)
        self.w = np.zeros(SIZE, np.float32)
        self.v = r.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)

    def raw(self, starts: np.ndarray, ids: np.ndarray, x: np.ndarray):
        vx = self.v[ids] * x[:, None]
        total = np.add.reduceat(vx, starts)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx * vx, starts)).sum(axis=1)
        return self.w0[0] + np.add.reduceat(self.w[ids] * x, starts) + pairs, vx, total

    def score(self, starts, ids, x) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(starts, ids, x)[0].astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, size: int = 128, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad, rows in a fixed order."""
    m, r = Machine(seed), np.random.default_rng(seed)
    gw, gv, g0 = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            lengths = [len(rows[k][0]) for k in pick]
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            ids, x = np.concatenate([rows[k][0] for k in pick]), np.concatenate([rows[k][1] for k in pick])
            z, vx, total = m.raw(starts, ids, x)
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)).astype(np.float32)
            e = np.repeat(err, lengths) * x
            used, where = np.unique(ids, return_inverse=True)
            dw = np.bincount(where, e, minlength=len(used)).astype(np.float32) + decay * m.w[used]
            per = e[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            dv = np.stack([np.bincount(where, per[:, f], minlength=len(used)) for f in range(RANK)], axis=1).astype(np.float32) + decay * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += float(err.sum()) ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            m.w0 -= rate * float(err.sum()) / np.sqrt(g0)
    return m


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    stated = docs["n_chars"].cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), stated.alias("stated"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Machine | None:
    """``labels``: (doc_id, quality) of the rows to learn from.  None without both kinds of label."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max("quality").alias("_quality"))
    sample = known.orderBy(F.xxhash64("_doc"), "_doc").limit(max_train)  # ids and labels only, at most max_train rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())])
        for b in batches:
            starts, ids, x = features(text_bytes(b.column("text")), b.column("stated").to_pylist())
            cuts = [*starts.tolist(), len(ids)]
            parts = list(zip(cuts[:-1], cuts[1:]))
            yield batch(schema, {"doc_id": b.column("doc_id").to_pylist(), "quality": b.column("quality").to_pylist(), "ids": [ids[s:e].astype(np.int32).tobytes() for s, e in parts], "x": [x[s:e].astype(np.float16).tobytes() for s, e in parts]})

    rows = _inputs(docs, id_col, text_col).join(F.broadcast(sample), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "stated", F.col("_quality").cast("int").alias("quality"))
    got = sorted(rows.mapInArrow(run, "doc_id long, quality int, ids binary, x binary").collect(), key=lambda r: (r["doc_id"], bytes(r["ids"])))
    y = np.array([r["quality"] for r in got], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    return fit([(np.frombuffer(r["ids"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float16).astype(np.float32)) for r in got], y)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _scores(m: Machine | None, texts: list[bytes], stated: list[int | None]) -> np.ndarray:
    if m is None:
        return np.full(len(texts), 0.5)
    return np.concatenate([m.score(*features(texts[a:b], stated[a:b])) for a, b in _chunks(texts)]) if texts else np.zeros(0)


def score_quality(docs: DataFrame, model: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row per row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(model, text_bytes(b.column("text")), b.column("stated").to_pylist())
            yield batch(schema, {"doc_id": b.column("doc_id").to_pylist(), "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return _inputs(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Machine | None, text_col: str = "text") -> DataFrame:
    """Rows that the model accepts, all columns as they are; nothing is shuffled."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at, stated = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(model, text_bytes(b.column(at)), b.column(stated).to_pylist() if stated is not None else [None] * b.num_rows)
            yield b.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows that op2 may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_quality(docs, train(docs, training_labels(labels)))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
