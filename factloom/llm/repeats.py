"""Removal of repeated byte strings by a distributed merge sort of sampled suffixes.

Removed is each byte covered by a ``LENGTH``-byte string that starts anywhere else too.

1. Every window of ``LENGTH`` bytes elects an anchor: the start of the ``GRAM``-byte string
   with the smallest hash in it, leftmost on ties.  Equal windows elect the same place, so
   suffixes at anchors (about one in a hundred bytes) are all that has to be sorted.
2. Anchors whose gram occurs once in the corpus drop out.  Anchors with equal surroundings
   (all bytes that any of its windows can hold, told by two 64-bit hashes, of the gram and
   of the whole) form a class; a class of two or more is repeated in full, so a group of
   copies of any size is one class and is not sorted.
3. Classes that share a gram meet as suffixes: tasks sort theirs, front-code the runs
   (common prefix length and the rest) and exchange them by gram; runs are combined by a
   loser tree that compares two suffixes only behind the prefix they are known to share.
   Its common-prefix lengths give how far any two agree to the right; in order of that
   length, neighbours merge into sets sorted by the bytes to the left, smaller into
   larger, so each class meets the one it agrees with furthest to the left for every
   length to the right.  Grams with more than ``LARGE`` classes, which no task should hold,
   are settled by hashes of each window instead, grouped over the cluster.
4. What is repeated around each anchor is joined back, intervals are united by document.

Defined results: null texts count as empty; texts under ``LENGTH`` bytes lose nothing;
texts of any length are read whole; a row that repeats id and text counts as another
occurrence, and all rows are reported; null ids stay null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, id_in, id_out, marker, shuffle_width, small_batches, stage, text_bytes

LENGTH, GRAM = 400, 200
LEFT = LENGTH - GRAM
#: Classes of one gram that one task compares.
LARGE = 20_000
SEGMENT = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64)


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any stretch of a text from sums of its bytes' values."""

    def __init__(self, text: bytes) -> None:
        n = len(text)
        self.up, down = _powers.get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[np.frombuffer(text, np.uint8)] * down[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.up[start])


def anchors(text: bytes, hashes: Hashes) -> np.ndarray:
    """Places that some window elects, in order."""
    n, width = len(text), LENGTH - GRAM + 1
    if n < LENGTH:
        return np.zeros(0, np.int64)
    grams = _mix((hashes.sums[GRAM:] - hashes.sums[:-GRAM]) * hashes.up[: n - GRAM + 1])
    out = []
    for at in range(0, len(grams) - width + 1, SEGMENT):
        own = grams[at : at + SEGMENT + width - 1]
        m = len(own)
        rows = -(-m // width)
        key = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        key[:m] = (own & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(m, dtype=np.uint64)
        grid = key.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        best = np.minimum(back[: m - width + 1], ahead[width - 1 : m]) & np.uint64(0xFFFFF)
        out.append(best[np.concatenate(([True], best[1:] != best[:-1]))].astype(np.int64) + at)
    return np.unique(np.concatenate(out))


ANCHORS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("gram", pa.int64()), ("around", pa.int64())])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts: dict[str, list] = {n: [] for n in ANCHORS.names}
        for i, th, text in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), text_bytes(b.column("text"))):
            if len(text) < LENGTH:
                continue
            h = Hashes(text)
            at = anchors(text, h)
            left, right = np.minimum(at, LEFT), np.minimum(len(text) - at, LENGTH)
            around = h.of(at - left, at + right) ^ (left * 1000003 + right).astype(np.uint64)
            for name, v in zip(ANCHORS.names, (np.full(len(at), i), np.full(len(at), th), at, left, right, h.of(at, at + GRAM).view(np.int64), _mix(around).view(np.int64))):
                parts[name].append(v)
        if parts["at"]:
            yield batch(ANCHORS, {k: np.concatenate(v) for k, v in parts.items()})


# --- front-coded runs --------------------------------------------------------------

def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> bytes:
    """Sorted suffixes as (shared with the one before, length of the rest) and the rests."""
    out, before = [np.array([len(suffixes)], np.uint32).tobytes()], b""
    heads, rests = np.zeros((len(suffixes), 2), np.uint16), []
    for k, s in enumerate(suffixes):
        p = common_prefix(before, s)
        heads[k] = p, len(s) - p
        rests.append(s[p:])
        before = s
    return b"".join([*out, heads.tobytes(), *rests])


def front_decode(run: bytes) -> Iterator[tuple[int, bytes]]:
    """(shared with the one before, suffix)"""
    n = int(np.frombuffer(run[:4], np.uint32)[0])
    at, before = 4 + 4 * n, b""
    for shared, rest in np.frombuffer(run[4:at], np.uint16).reshape(n, 2).tolist():
        before = before[:shared] + run[at : at + rest]
        at += rest
        yield shared, before


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, place in it, prefix shared with the suffix before, suffix) of all runs in order.

    Each player of the loser tree carries the prefix it shares with the last suffix put
    out.  The longer one wins without looking at a byte; only equals are compared, and
    behind that prefix.
    """
    k = len(runs)
    streams = [front_decode(r) for r in runs]
    suffix: list[bytes | None] = [None] * k
    shared, place = [0] * k, [-1] * k

    def advance(s: int) -> None:
        item = next(streams[s], None)
        place[s] += 1
        shared[s], suffix[s] = item if item is not None else (-1, None)

    def beats(a: int, b: int) -> bool:
        """Whether a goes first; the loser's shared prefix then refers to the winner."""
        if suffix[a] is None or suffix[b] is None:
            return suffix[b] is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        x, y = suffix[a], suffix[b]
        p = common_prefix(x, y, shared[a])
        first = (len(x), a) < (len(y), b) if p == min(len(x), len(y)) else x[p] < y[p]
        shared[b if first else a] = p
        return first

    for s in range(k):
        advance(s)
    losers = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b

    winner = play(1) if k > 1 else 0
    while suffix[winner] is not None:
        yield winner, place[winner], shared[winner], suffix[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def agreements(shared: list[int], lefts: list[bytes]) -> list[tuple[int, int]]:
    """For suffixes in order, with the bytes to their left reversed: the largest stretch
    (left, right) around each anchor that lies in a common window of ``LENGTH`` bytes; (0, 0) if none does.

    ``shared[k]`` is the prefix that suffix k shares with the one before.
    """
    n = len(lefts)
    out = [(0, 0)] * n
    home = list(range(n))
    sets: dict[int, list[tuple[bytes, int]]] = {k: [(lefts[k], k)] for k in range(n)}

    def find(k: int) -> int:
        while home[k] != k:
            home[k] = home[home[k]]
            k = home[k]
        return k

    def meet(a: tuple[bytes, int], b: tuple[bytes, int], right: int) -> None:
        left = common_prefix(a[0], b[0])
        if left + right >= LENGTH:
            for _, k in (a, b):
                out[k] = (max(out[k][0], left), max(out[k][1], right))

    for k in sorted(range(1, n), key=lambda k: -shared[k]):
        right, a, b = shared[k], find(k - 1), find(k)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        own = sets[a]
        for item in sets.pop(b):
            at = bisect_left(own, item)
            if at:
                meet(own[at - 1], item, right)
            if at < len(own):
                meet(item, own[at], right)
            insort(own, item)
        home[b] = a
    return out


RUN = "bucket int, run binary, lefts binary, sizes binary, gram binary, around binary"
RUN_ARROW = pa.schema([("bucket", pa.int32()), ("run", pa.binary()), ("lefts", pa.binary()), ("sizes", pa.binary()), ("gram", pa.binary()), ("around", pa.binary())])
#: Suffixes a task gathers before it sorts and hands them on.
RUN_ROWS = 100_000


def _contexts(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(gram, around, multiplicity, suffix, reversed left) of the classes that a document stands for."""
    for text, classes in zip(text_bytes(b.column("text")), b.column("classes").to_pylist()):
        for c in classes:
            at = c["at"]
            yield c["gram"], c["around"], c["n"], text[at : at + c["right"]], text[at - c["left"] : at][::-1]


def _make_runs(buckets: int):
    def pack(rows: list) -> pa.RecordBatch:
        cut: dict[int, list] = {}
        for r in rows:
            cut.setdefault(r[0] % buckets, []).append(r)
        cols: dict[str, list] = {n: [] for n in RUN_ARROW.names}
        for bucket, own in cut.items():
            own.sort(key=lambda r: (r[3], r[4], r[1]))
            cols["bucket"].append(bucket)
            cols["run"].append(front_code([r[3] for r in own]))
            cols["lefts"].append(b"".join(r[4] for r in own))
            cols["sizes"].append(np.array([len(r[4]) for r in own], np.uint16).tobytes())
            cols["gram"].append(np.array([r[0] for r in own], np.int64).tobytes())
            cols["around"].append(np.array([r[1] for r in own], np.int64).tobytes())
        return batch(RUN_ARROW, cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for b in batches:
            for r in _contexts(b):
                rows.append(r)
                if len(rows) >= RUN_ROWS:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)

    return run


FOUND = "gram long, around long, lo int, hi int"


def _merge_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    grams = [np.frombuffer(x, np.int64) for x in pdf["gram"]]
    arounds = [np.frombuffer(x, np.int64) for x in pdf["around"]]
    ends = [np.concatenate(([0], np.cumsum(np.frombuffer(x, np.uint16).astype(np.int64)))) for x in pdf["sizes"]]
    lefts = list(pdf["lefts"])
    rows: list[tuple[int, int, int, int]] = []
    names: list[tuple[int, int]] = []
    shared: list[int] = []
    before: list[bytes] = []

    def settle() -> None:
        if len(names) > 1:
            rows.extend((g, a, lo, hi) for (g, a), (lo, hi) in zip(names, agreements(shared, before)) if hi)
        names.clear()
        shared.clear()
        before.clear()

    for r, k, p, _ in merge_runs(list(pdf["run"])):
        if p < GRAM:
            settle()
        names.append((int(grams[r][k]), int(arounds[r][k])))
        shared.append(p)
        before.append(lefts[r][ends[r][k] : ends[r][k + 1]])
    settle()
    return pd.DataFrame(rows, columns=["gram", "around", "lo", "hi"])


WINDOWS = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("delta", pa.int32()), ("window", pa.int64())])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of each class."""
    for b in batches:
        for gram, around, _, suffix, left in _contexts(b):
            h = Hashes(left[::-1] + suffix)
            delta = np.arange(max(0, LENGTH - len(suffix)), len(left) + 1)
            start = len(left) - delta
            m = len(delta)
            yield batch(WINDOWS, {"gram": np.full(m, gram), "around": np.full(m, around), "delta": delta, "window": h.of(start, start + LENGTH).view(np.int64)})


def _of_large(rows: DataFrame) -> DataFrame:
    """The same for grams with very many classes: equal windows at equal distance from the anchor."""
    windows = stage(rows.mapInArrow(_windows, "gram long, around long, delta int, window long"), "repeat-windows")
    keys = ["gram", "delta", "window"]
    twice = windows.groupBy(*keys).count().filter("count > 1").drop("count")
    return windows.join(twice.hint("merge"), keys, "left_semi").groupBy("gram", "around").agg(F.max("delta").alias("lo"), (F.lit(LENGTH) - F.min("delta")).cast("int").alias("hi"))


# --- the whole ---------------------------------------------------------------------

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])


def unite(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: dict[str, list] = {n: [] for n in OUT.names}
        for i, text, parts in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), b.column("parts").to_pylist()):
            spans = unite([(p["a"], p["b"]) for p in parts or ()])
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            for name, v in zip(OUT.names, (i, len(text), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [list(x) for x in spans])):
                cols[name].append(v)
        yield batch(OUT, cols)


def repeated_spans(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, th, parts: the repeated stretches of the rows of ``docs(doc_id, th, text)`` that have any."""
    spark = docs.sparkSession
    small_batches(spark)
    found = stage(docs.filter(F.octet_length("text") >= LENGTH).mapInArrow(_anchors, "doc_id long, th long, at long, left int, right int, gram long, around long"), "repeat-anchors")
    twice = stage(found.groupBy("gram").count().filter("count > 1").select("gram"), "repeat-grams")
    near = stage(found.filter(marker(twice, ["gram"])("gram")).join(twice.hint("merge"), "gram", "left_semi"), "repeat-candidates")
    classes = stage(near.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at", "left", "right")).alias("rep")), "repeat-classes")
    kinds = stage(classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("gram", "kinds"), "repeat-kinds")
    open_ = stage(classes.join(kinds.hint("merge"), "gram").select("gram", "around", "n", "kinds", "rep.*"), "repeat-open")

    def with_text(rows: DataFrame) -> DataFrame:
        own = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("gram", "around", "n", "at", "left", "right")).alias("classes"))
        texts = docs.filter(marker(rows, ["doc_id", "th"])("doc_id", "th")).dropDuplicates(["doc_id", "th"])
        return texts.join(own.hint("shuffle_hash"), ["doc_id", "th"]).select("text", "classes")

    buckets = shuffle_width(spark) * 2
    runs = with_text(open_.filter(F.col("kinds") <= large)).mapInArrow(_make_runs(buckets), RUN)
    hits = runs.groupBy("bucket").applyInPandas(_merge_bucket, FOUND)
    many = open_.filter(F.col("kinds") > large)
    if not many.isEmpty():
        hits = hits.unionByName(_of_large(with_text(many)))
    whole = classes.filter("n > 1").select("gram", "around", F.col("rep.left").alias("lo"), F.col("rep.right").alias("hi"))
    some = hits.join(whole.hint("merge"), ["gram", "around"], "left_anti")
    spans = stage(whole.unionByName(some), "repeat-hits")
    placed = near.join(spans.hint("merge"), ["gram", "around"])
    return stage(placed.groupBy("doc_id", "th").agg(F.collect_list(F.struct((F.col("at") - F.col("lo")).alias("a"), (F.col("at") + F.col("hi")).alias("b"))).alias("parts")), "repeat-parts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: one row per row of ``docs``."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = docs.select(id_in(docs[id_col]).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    parts = repeated_spans(own, large)
    own = own.withColumn("may", marker(parts, ["doc_id", "th"])("doc_id", "th"))
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    cut = own.filter("may").drop("may").join(parts.hint("shuffle_hash"), ["doc_id", "th"], "left").select("doc_id", "text", "parts").mapInArrow(_cut, kinds)
    zero = F.lit(0).cast("long")
    clean = own.filter("not may").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<array<bigint>>").alias("spans"))
    return cut.unionByName(clean).withColumn("doc_id", id_out("doc_id"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("spans")
