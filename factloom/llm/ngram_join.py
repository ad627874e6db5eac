"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its word shingles; two link when 100 * |both| >= 75 * |either|.

1. One pass names each document's class (equal sets are one class throughout) and counts
   shingles that many documents of a partition share; the most frequent ones, a bounded
   list, only decide the order below, never the result.
2. Each set is ordered from rare to frequent.  Linked sets x and y share at least
   l = min(l(x), l(y)) of their first n - ceil(3n/4) + l(n) shingles, l(n) = 1 + n // 16.
   A second pass counts for each set how many of these occur in any other set; with fewer
   than the smallest l of a possible partner, a set links to nothing and is done.  Tasks
   tell their own repeats apart first, so a shingle that all documents have costs one
   posting a task.
3. A third pass reads one document of each class that is left.  Linked sets share one of
   their first n - ceil(3n/4) + 1 shingles, so they meet in an inverted list.  Postings
   carry the sizes and a parity sketch of the whole sets; two members of a list are tied
   only if the sketches allow them to link: sets that differ in d shingles differ in at most
   d bits, and linked ones have 7d <= n + m.  A list that is very long already in one task,
   or over all, ties its members to its first one instead of comparing sketches, which
   keeps a huge group of near copies linear.  Ties only decide which sets meet.
4. Classes that ties connect meet with their whole sets.  There each set is a query against
   the inverted lists of those before it: T = ceil(3n/4) occurrences are needed, the
   longest lists are set aside, the short ones are heap-merged, and what they leave is
   probed in the long ones by binary search (DivideSkip); every link comes from here.  Sets
   already known to be connected needn't be compared: members of a large component get
   lists of their own and are skipped by their own kind.
5. A component of more than ``block`` classes is cut into blocks.  In a first round each
   block also holds the same few pivots of the component, which connects most of it; in
   the second, only blocks with sets outside the component's largest connected part
   meet the others of compatible sizes.  So no link is lost and no task is unbounded.

Defined results: null, empty and blank texts have no shingles, link with nothing and
are their own component; fewer words than ``width`` form one shingle; null ids sort lowest
and stay null; rows that repeat an id are reported each, under that id's class or, where
their texts differ, classes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, documents, id_in, id_out, is_marked, keep_rows, marks, own_cache, shuffle_width, small_batches, spot, stage, text_bytes
from .components import connected_components

WIDTH = 5
#: Shingles whose frequency the order knows, and postings a task gathers before it ties them.
FREQUENT, FLUSH = 1 << 16, 1 << 19
#: Classes that meet in one task, pivots a block holds besides, members from which a component has its own lists.
BLOCK, PIVOTS, OWN_LISTS = 1024, 16, 64
#: Members from which a list of one task, and one of all, is tied to its first member.
LONG_HERE, LONG = 256, 2048
#: Least and largest logarithm of the bits of a sketch.
SKETCH = (6, 12)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHashes()
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text with A-Z lowered."""
    words = text.lower().split()  # bytes split at blank and \t \n \v \f \r
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    span = min(n, width)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = out * _PRIME + h[k : n - span + 1 + k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def class_of(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), seed=len(tokens))).astype(np.int64)))


def need(n: int) -> int:
    """Occurrences that a set of n shares at least with any set it links to."""
    return (3 * n + 3) // 4


def linked(both: int, n: int, m: int) -> bool:
    return 100 * both >= 75 * (n + m - both)


# --- postings ----------------------------------------------------------------------

SURVEY = "kind int, a long, b long, n long, hash long"
SURVEY_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("hash", pa.int64())])


def _survey(width: int):
    """Kind 0: documents with class, size of the set and hash of the text; 1: frequent shingles of the partition."""

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(parts), return_counts=True)
        many = n >= 3
        token, n = token[many], n[many]
        top = np.argsort(-n, kind="stable")[:FREQUENT]
        none = [None] * len(top)
        return batch(SURVEY_ARROW, {"kind": [1] * len(top), "a": token[top].view(np.int64), "b": none, "n": n[top], "hash": none})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("shingles", _words)
        parts, size = [], 0
        for b in batches:
            own, sizes = [], []
            for text in text_bytes(b.column("text")):
                t = shingle_hashes(text, width)
                own.append(class_of(t) if len(t) else None)
                sizes.append(len(t))
                parts.append(t)
                size += len(t)
                if size >= 2 * FLUSH:
                    yield emit(parts)
                    parts, size = [], 0
            yield batch(SURVEY_ARROW, {"kind": [0] * len(own), "a": b.column("doc_id"), "b": own, "n": sizes, "hash": b.column("hash")})
        if parts:
            yield emit(parts)

    return run


def share(n: int) -> int:
    """Shingles that the prefixes of two linked sets of size n or more have in common."""
    return 1 + n // 16


class Order:
    """From rare to frequent: shingles of the frequent list last, by frequency, others by hash."""

    def __init__(self, token: np.ndarray, weight: np.ndarray) -> None:
        by = np.argsort(token)
        self.token, self.weight = token[by], weight[by]

    def prefix(self, tokens: np.ndarray, shared: int) -> np.ndarray:
        """The first shingles of a set, of which any linked set has ``shared`` among its own."""
        n = len(tokens)
        k = min(n, n - need(n) + shared)
        at = np.minimum(np.searchsorted(self.token, tokens), max(len(self.token) - 1, 0))
        heavy = self.token[at] == tokens if len(self.token) else np.zeros(n, bool)
        light = tokens[~heavy]
        if len(light) >= k:
            return light[:k]
        rest = tokens[heavy]
        return np.concatenate((light, rest[np.lexsort((rest, self.weight[at[heavy]]))][: k - len(light)]))


def runs_of(tokens: np.ndarray, *others: np.ndarray):
    """Everything sorted by token and then by the others, first places and lengths of the runs of equal tokens."""
    order = np.lexsort((*reversed(others), tokens))
    tokens = tokens[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
    return tokens, [x[order] for x in others], first, np.diff(np.concatenate((first, [len(tokens)])))


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


COUNTED = "bucket int, kind int, tokens binary, classes binary, flags binary"
COUNTED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("tokens", pa.binary()), ("classes", pa.binary()), ("flags", pa.binary())])


def _postings(width: int, bits: int, shared):
    """Kind 1: one posting a shingle and task, flagged if its classes are counted; 2: counts of shingles that other sets of the task have."""
    shift = np.uint64(64 - bits)

    def flush(tokens: list[np.ndarray], classes: list[int], where: int) -> pa.RecordBatch:
        t, (c,), first, size = runs_of(np.concatenate(tokens), np.repeat(np.array(classes, np.int64), [len(x) for x in tokens]))
        own, n = np.unique(c[np.repeat(size > 1, size)], return_counts=True)
        t, c, flags = t[first], c[first], (size > 1).astype(np.uint8)
        bucket = (t >> shift).astype(np.int64)
        rows = [(int(bucket[s]), 1, t[s:e].tobytes(), c[s:e].tobytes(), flags[s:e].tobytes()) for s, e in _cuts(bucket)]
        rows.append((where % (1 << bits), 2, n.astype(np.int64).tobytes(), own.tobytes(), b""))
        return batch(COUNTED_ARROW, dict(zip(COUNTED_ARROW.names, zip(*rows))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("shingles", _words)
        order = Order(*shared.value)
        where = TaskContext.get().partitionId()
        tokens, classes, seen, size = [], [], set(), 0
        for b in batches:
            for text in text_bytes(b.column("text")):
                t = shingle_hashes(text, width)
                own = class_of(t)
                if len(t) and own not in seen:
                    seen.add(own)
                    tokens.append(order.prefix(t, share(len(t))))
                    classes.append(own)
                    size += len(tokens[-1])
            if size >= FLUSH:
                yield flush(tokens, classes, where)
                tokens, classes, seen, size, where = [], [], set(), 0, where + 1
        if tokens:
            yield flush(tokens, classes, where)

    return run


def _count_bucket(bits: int):
    shift = np.uint64(64 - bits)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """How many of its first shingles a class shares, as far as this bucket knows; packed by the part that a class belongs to."""
        lists, told = pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 2]
        classes = [np.frombuffer(b"".join(told["classes"]), np.int64)]
        counts = [np.frombuffer(b"".join(told["tokens"]), np.int64)]
        if len(lists):
            t, (c, f), first, size = runs_of(*(np.frombuffer(b"".join(lists[x]), kind) for x, kind in (("tokens", np.uint64), ("classes", np.int64), ("flags", np.uint8))))
            fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))  # a class may come from several tasks
            common = np.repeat(np.add.reduceat(fresh.astype(np.int64), first) > 1, size)
            own, n = np.unique(c[fresh & common & (f == 0)], return_counts=True)
            classes.append(own)
            counts.append(n)
        a, n = _sums(np.concatenate(classes), np.concatenate(counts))
        part = (a.view(np.uint64) >> shift).astype(np.int64)
        order = np.argsort(part, kind="stable")
        a, n, part = a[order], n[order], part[order]
        cut = _cuts(part) if len(part) else []
        return pd.DataFrame({"part": [int(part[s]) for s, _ in cut], "a": [a[s:e].tobytes() for s, e in cut], "n": [n[s:e].tobytes() for s, e in cut]})

    return count


def _sums(a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, at = np.unique(a, return_inverse=True)
    return a, np.bincount(at, n, minlength=len(a)).astype(np.int64)


def _sum_part(pdf: pd.DataFrame) -> pd.DataFrame:
    a, n = _sums(*(np.frombuffer(b"".join(pdf[c]), np.int64) for c in "an"))
    return pd.DataFrame({"cls": a, "common": n})


# --- ties: which sets meet ---------------------------------------------------------

def level(n: np.ndarray) -> np.ndarray:
    """Logarithm of the bits of the sketch of a set of n: more than n bits, at most twice as many."""
    return np.clip(np.frexp(np.asarray(n, np.float64))[1], *SKETCH)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit; the halves of a sketch give the next smaller one."""
    bits = 1 << int(level(len(tokens)))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


class Sketches:
    """Sets by place: tells which pairs may link."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.n, self.level = sizes.astype(np.int64), level(sizes)
        wide = 1 << (self.level - 6)
        start = np.cumsum(wide) - wide
        self.row, self.table = {}, {}
        for k in np.unique(self.level).tolist():
            own, larger = np.flatnonzero(self.level == k), np.flatnonzero(self.level == k + 1)
            at = lambda which, w: words[start[which][:, None] + np.arange(w)]
            twice, w = at(larger, 2 << (k - 6)), 1 << (k - 6)
            self.table[k] = np.concatenate((at(own, w), twice[:, :w] ^ twice[:, w:]))
            self.row[k] = np.full(len(sizes), -1)
            self.row[k][np.concatenate((own, larger))] = np.arange(len(own) + len(larger))

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = self.n[a], self.n[b]
        out = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
        least = np.minimum(self.level[a], self.level[b])
        for k in np.unique(least[out]).tolist():
            at, table, row = np.flatnonzero(out & (least == k)), self.table[k], self.row[k]
            step = max(1, (1 << 22) >> k)
            for s in range(0, len(at), step):
                some = at[s : s + step]
                apart = np.bitwise_count(table[row[a[some]]] ^ table[row[b[some]]]).sum(axis=1, dtype=np.int64)
                out[some] = 7 * apart <= n[some] + m[some]
        return out


def spanning(first: np.ndarray, size: np.ndarray, member: np.ndarray, sets: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all members of one list that may link, each with the first of its kind; members of a list are sorted by size."""
    label = np.arange(len(sets.n))
    many = size > 1
    room = np.repeat(size - 1, size) - (np.arange(len(member)) - np.repeat(first, size))
    at, gap = np.flatnonzero(np.repeat(many, size)), 0
    while True:
        gap += 1
        at = at[room[at] >= gap]
        a, b = member[at], member[at + gap]
        fit = 4 * sets.n[a] >= 3 * sets.n[b]  # those further on are larger still
        at, a, b = at[fit], a[fit], b[fit]
        if not len(at):
            break
        new = label[a] != label[b]
        a, b = a[new], b[new]
        ok = sets.may_link(a, b)
        if not ok.any():
            continue
        a, b = a[ok], b[ok]
        root: dict[int, int] = {}

        def find(k: int) -> int:
            while (up := root.get(k, k)) != k:
                k = up
            return k

        for x, y in zip(label[a].tolist(), label[b].tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        to = np.arange(len(label))
        for k in root:
            to[k] = find(k)
        label = to[label]
    own = np.flatnonzero(label != np.arange(len(label)))
    return own, label[own]


LISTED = "bucket int, tokens binary, places binary, flags binary, classes binary, sizes binary, sketches binary, a binary, b binary"
LISTED_ARROW = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("tokens", "places", "flags", "classes", "sizes", "sketches", "a", "b"))])


def _lists(bits: int, shared):
    """Of classes with their sets: postings of a bucket (flag: a list that is long here) with the sets' sizes and sketches, and ties of long lists."""
    shift = np.uint64(64 - bits)

    def flush(tokens: list[np.ndarray], classes: list[int], sizes: list[int], sketches: list[np.ndarray], where: int) -> pa.RecordBatch:
        cls, n = np.array(classes, np.int64), np.array(sizes, np.int32)
        t, (at,), first, size = runs_of(np.concatenate(tokens), np.repeat(np.arange(len(cls), dtype=np.int32), [len(x) for x in tokens]))
        inside = np.repeat(size > LONG_HERE, size)
        ties = np.unique(np.column_stack((at, np.repeat(at[first], size)))[inside], axis=0)
        kept = ~inside
        kept[first] = True
        t, at, flags = t[kept], at[kept], inside[kept].astype(np.uint8)
        bucket = (t >> shift).astype(np.int64)
        rows = [(where % (1 << bits), b"", b"", b"", b"", b"", b"", cls[ties[:, 0]].tobytes(), cls[ties[:, 1]].tobytes())] if len(ties) else []
        for s, e in _cuts(bucket):
            here, place = np.unique(at[s:e], return_inverse=True)
            rows.append((int(bucket[s]), t[s:e].tobytes(), place.astype(np.int32).tobytes(), flags[s:e].tobytes(), cls[here].tobytes(), n[here].tobytes(), b"".join(sketches[k].tobytes() for k in here.tolist()), b"", b""))
        return batch(LISTED_ARROW, dict(zip(LISTED_ARROW.names, zip(*rows))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*shared.value)
        where = TaskContext.get().partitionId()
        tokens, classes, sizes, sketches, size = [], [], [], [], 0
        for b in batches:
            for cls, own in zip(b.column("cls").to_pylist(), b.column("tokens").to_pylist()):
                t = np.frombuffer(own, np.uint64)
                tokens.append(order.prefix(t, 1))
                classes.append(cls)
                sizes.append(len(t))
                sketches.append(sketch(t))
                size += len(tokens[-1])
                if size >= FLUSH:
                    yield flush(tokens, classes, sizes, sketches, where)
                    tokens, classes, sizes, sketches, size, where = [], [], [], [], 0, where + 1
        if tokens:
            yield flush(tokens, classes, sizes, sketches, where)

    return run


def _tie_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ties (a, b) of one bucket of shingles."""
    joined = {c: b"".join(pdf[c]) for c in pdf.columns if c != "bucket"}
    out = [np.column_stack([np.frombuffer(joined[c], np.int64) for c in "ab"])]
    classes, sizes = np.frombuffer(joined["classes"], np.int64), np.frombuffer(joined["sizes"], np.int32)
    if len(classes):
        held = np.array([len(x) // 8 for x in pdf["classes"]])
        place = np.frombuffer(joined["places"], np.int32) + np.repeat(np.cumsum(held) - held, [len(x) // 4 for x in pdf["places"]])
        cls, where, which = np.unique(classes, return_index=True, return_inverse=True)  # a class may come from several tasks
        wide = 1 << (level(sizes) - 6)
        start = np.cumsum(wide) - wide
        words = np.frombuffer(joined["sketches"], np.uint64)
        sets = Sketches(sizes[where], np.concatenate([words[start[k] : start[k] + wide[k]] for k in where.tolist()]))
        t, (_, c, f), first, size = runs_of(np.frombuffer(joined["tokens"], np.uint64), sizes[place], which[place], np.frombuffer(joined["flags"], np.uint8))
        long = (size > LONG) | (np.maximum.reduceat(f, first) > 0)
        inside = np.repeat(long, size)
        tied = np.unique(np.column_stack((c, np.repeat(c[first], size)))[inside], axis=0)
        out.append(cls[tied[tied[:, 0] != tied[:, 1]]].reshape(-1, 2))
        short = size[~long]
        out.append(np.column_stack([cls[x] for x in spanning(np.cumsum(short) - short, short, c[~inside], sets)]))
    pairs = np.array(stars(np.concatenate(out).tolist()), np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


# --- T-occurrence search -----------------------------------------------------------

class Lists:
    """Inverted lists of sets; members are added in increasing order, so lists are sorted."""

    def __init__(self) -> None:
        self.of: dict[int, list[int]] = {}

    def add(self, member: int, tokens: list[int]) -> None:
        of = self.of
        for t in tokens:
            own = of.get(t)
            if own is None:
                of[t] = [member]
            elif own[-1] < member:
                own.append(member)
            elif (at := bisect_left(own, member)) == len(own) or own[at] != member:
                own.insert(at, member)

    def drop(self, member: int, tokens: list[int]) -> None:
        for t in tokens:
            own = self.of[t]
            own.remove(member)
            if not own:
                del self.of[t]

    def search(self, tokens: list[int], t: int) -> Iterator[tuple[int, int]]:
        """(member, occurrences) of members on at least ``t`` of the query's lists: DivideSkip."""
        of = self.of
        lists = [own for own in map(of.get, tokens) if own is not None]
        if len(lists) < t:
            return
        lists.sort(key=len, reverse=True)
        apart = min(t - 1, int(t / (0.01 * max(len(lists[0]).bit_length(), 1) + 1)))
        long, short = lists[:apart], lists[apart:]
        for member, run in groupby(heapq.merge(*short) if len(short) > 1 else short[0] if short else ()):
            count = sum(1 for _ in run)
            if count < t - apart:
                continue
            for k, own in enumerate(long):
                if count + len(long) - k < t:
                    break
                at = bisect_left(own, member)
                count += at < len(own) and own[at] == member
            if count >= t:
                yield member, count


def link_sets(ids: list[int], sets: list[np.ndarray], parts: list[int]) -> list[tuple[int, int]]:
    """Links that connect all linked sets, beyond ``parts`` that are connected already.

    Returns a forest over the given ids, not every link.
    """
    sizes = [len(x) for x in sets]
    _, local, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.split(np.where(often[local] > 1, local, -1), np.cumsum(sizes)[:-1])
    sets = [x[x >= 0] for x in common]  # a shingle of one set only can't be shared
    order = sorted(range(len(ids)), key=lambda k: (sizes[k], ids[k]))
    root, members = list(range(len(ids))), {}
    seeded: dict[int, int] = {}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in order:
        root[k] = seeded.setdefault(parts[k], k)
    rank = {k: r for r, k in enumerate(order)}
    tokens = {}
    out: list[tuple[int, int]] = []
    shared, own_lists = Lists(), {}  # lists of small parts; lists of each large one

    def join(a: int, b: int) -> int:
        a, b = find(a), find(b)
        if a == b:
            return a
        if len(members.get(a, ())) < len(members.get(b, ())):
            a, b = b, a
        root[b] = a
        moved, base = members.pop(b, []), members.setdefault(a, [])
        mine, its = own_lists.get(a), own_lists.pop(b, None)
        if mine is None and its is not None:
            for m in base:
                shared.drop(rank[m], tokens[m])
                its.add(rank[m], tokens[m])
            own_lists[a] = its
        elif mine is not None:
            for m in moved:
                if its is None:
                    shared.drop(rank[m], tokens[m])
                mine.add(rank[m], tokens[m])
        base.extend(moved)
        return a

    def place(k: int) -> None:
        r = find(k)
        members.setdefault(r, []).append(k)
        if r in own_lists:
            own_lists[r].add(rank[k], tokens[k])
            return
        shared.add(rank[k], tokens[k])
        if len(members[r]) > OWN_LISTS:
            own_lists[r] = Lists()
            for m in members[r]:
                shared.drop(rank[m], tokens[m])
                own_lists[r].add(rank[m], tokens[m])

    for k in order:
        n = sizes[k]
        tokens[k] = sets[k].tolist()
        t = need(n)
        for r in list(own_lists):
            if find(r) != r or find(k) == r:
                continue
            for m in (members[r][-1], members[r][len(members[r]) // 2], members[r][0]):
                if linked(len(np.intersect1d(sets[k], sets[m], assume_unique=True)), n, sizes[m]):
                    out.append((ids[k], ids[m]))
                    join(k, m)
                    break
            else:
                for m, both in own_lists[r].search(tokens[k], t):
                    if linked(both, n, sizes[order[m]]):
                        out.append((ids[k], ids[order[m]]))
                        join(k, order[m])
                        break
        hits = [order[m] for m, both in shared.search(tokens[k], t) if find(order[m]) != find(k) and linked(both, n, sizes[order[m]])]
        for m in hits:
            if find(m) != find(k):
                out.append((ids[k], ids[m]))
                join(k, m)
        place(k)
    return stars(out)


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components with each member linked to the smallest, so that few rounds join them later."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = k = root[up]
        return k

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [(k, find(k)) for k in list(root) if find(k) != k]


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by ``task``; one task's rows are linked together."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: dict[int, tuple[bytes, int]]) -> list[tuple[int, int]]:
        ids = list(rows)
        return link_sets(ids, [np.frombuffer(rows[i][0], np.uint64) for i in ids], [rows[i][1] for i in ids])

    task, rows, found = None, {}, []
    for b in batches:
        for key, cls, tokens, part in zip(*(b.column(c).to_pylist() for c in ("task", "cls", "tokens", "part"))):
            if key != task:
                if len(rows) > 1:
                    found += links(rows)
                task, rows = key, {}
            rows[cls] = (tokens, part)
        if found:
            yield batch(schema, {"a": [x[0] for x in found], "b": [x[1] for x in found]})
            found = []
    if len(rows) > 1:
        found = links(rows)
        if found:
            yield batch(schema, {"a": [x[0] for x in found], "b": [x[1] for x in found]})


def _link(rows: DataFrame) -> DataFrame:
    """``rows``: task string, cls, tokens, part."""
    width = shuffle_width(rows.sparkSession)
    return rows.repartition(width, "task").sortWithinPartitions("task").mapInArrow(_link_groups, "a long, b long")


# --- candidates with their sets ----------------------------------------------------

def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cls, n, tokens for each class in ``wanted(rep, cls, n)``; texts aren't shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("tokens", pa.binary())])

    shared, bits = marks(wanted, ["rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("shingles", _words)
        for b in batches:
            b = b.filter(pa.array(is_marked(shared.value, b.column("at").to_numpy())))
            ids, own, sets = [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
                t = shingle_hashes(text, width)
                if len(t):
                    ids.append(i)
                    own.append(class_of(t))
                    sets.append(t.tobytes())
            yield batch(schema, {"doc_id": ids, "own": own, "tokens": sets})

    rows = docs.withColumn("at", spot(["doc_id"], bits)).mapInArrow(run, "doc_id long, own long, tokens binary")
    return rows.join(wanted.hint("shuffle_hash"), (rows["doc_id"] == wanted["rep"]) & (rows["own"] == wanted["cls"])).select("cls", "n", "tokens")  # a repeated row repeats its class, which does no harm


def _ties(sets: DataFrame, bits: int, shared) -> DataFrame:
    """Edges whose components hold every linked pair of the classes in ``sets``; see 3 above."""
    return sets.mapInArrow(_lists(bits, shared), LISTED).groupBy("bucket").applyInPandas(_tie_bucket, "a long, b long")


def _blocks(sets: DataFrame, order: list[str], block: int) -> DataFrame:
    """Adds ``blk``: runs of ``block`` rows in the given order over the whole cluster."""
    spark = sets.sparkSession
    keys = sets.select("cls", *order)
    keys = keys.repartitionByRange(shuffle_width(spark), *order, "cls").sortWithinPartitions(*order, "cls").withColumn("at", F.monotonically_increasing_id())
    keys = stage(keys, "join-order")
    part = F.shiftright("at", 33)
    sizes = sorted((r["p"], r["n"]) for r in keys.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "p long, before long")
    return keys.withColumn("p", part).join(F.broadcast(starts), "p").select(*keys.drop("at").columns, F.floor((F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")) / block).alias("blk"))


def _link_large(sets: DataFrame, block: int) -> DataFrame:
    """Links of the components that don't fit one task; see 5 above."""
    placed = _blocks(sets, ["comp", "n"], block).select("cls", "blk")
    rows = stage(sets.join(placed.hint("merge"), "cls"), "join-sets")
    pivots = rows.withColumn("at", F.row_number().over(Window.partitionBy("comp").orderBy("cls"))).filter(F.col("at") <= PIVOTS).drop("blk", "at")
    each = rows.select("comp", "blk").distinct()
    task = F.concat_ws("/", "comp", "blk").alias("task")
    first = rows.select(task, "cls", "tokens", F.col("cls").alias("part")).unionByName(each.join(pivots.hint("merge"), "comp").select(task, "cls", "tokens", F.col("cls").alias("part")))
    links = stage(_link(first), "join-links")
    parts = connected_components(links).withColumnRenamed("node", "cls").withColumnRenamed("component", "part")
    known = stage(rows.select("cls", "comp", "n").join(parts.hint("merge"), "cls", "left").withColumn("part", F.coalesce("part", "cls")), "join-parts")
    main = known.groupBy("comp", "part").agg(F.count("*").alias("size")).groupBy("comp").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.count("*").alias("parts"))
    main = stage(main.filter("parts > 1").select("comp", "main"), "join-main")
    if main.isEmpty():
        return links
    known = known.join(main.hint("merge"), "comp").withColumn("aside", F.col("part") != F.col("main"))
    again = stage(_blocks(known.select("cls", "comp", "part", "n", "aside"), ["comp", "aside", "part", "n"], block), "join-blocks")
    about = stage(again.groupBy("comp", "blk").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("aside").alias("aside")), "join-about")
    other = about.select("comp", *[F.col(c).alias(f"{c}2") for c in ("blk", "low", "high", "least", "most", "aside")])
    one_part = (F.col("low") == F.col("high")) & (F.col("low2") == F.col("high2")) & (F.col("low") == F.col("low2"))
    fits = (F.col("most") * 4 >= F.col("least2") * 3) & (F.col("most2") * 4 >= F.col("least") * 3)
    pairs = about.filter("aside").join(other.hint("merge"), "comp").filter((~F.col("aside2") | (F.col("blk") <= F.col("blk2"))) & ~one_part & fits).select("comp", "blk", "blk2")
    pairs = stage(pairs, "join-pairs")
    task = F.concat_ws("/", "comp", "blk", "blk2").alias("task")
    ends = pairs.select("comp", "blk", task).unionByName(pairs.select("comp", F.col("blk2").alias("blk"), task)).distinct()
    second = again.select("cls", "comp", "part", "blk").join(ends.hint("merge"), ["comp", "blk"]).join(sets.select("cls", "tokens").hint("merge"), "cls").select("task", "cls", "tokens", "part")
    return links.unionByName(_link(second))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, first_hash: one row per row of ``docs``.

    ``first_hash`` is the text hash of the component's first row, which matters where rows repeat an id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(id_in(docs[id_col]).alias("doc_id"), docs[text_col].cast("string").alias("text"))
    survey = stage(own.withColumn("hash", F.xxhash64("text")).mapInArrow(_survey(width), SURVEY), "join-survey")
    rows = survey.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), "n", "hash")
    top = survey.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(FREQUENT).toArrow()
    shared = spark.sparkContext.broadcast((top["a"].to_numpy().view(np.uint64), top["n"].to_numpy()))  # at most FREQUENT pairs
    bits = min(20, max(4, (shuffle_width(spark) - 1).bit_length() + 1))
    counts = own.select("text").mapInArrow(_postings(width, bits, shared), COUNTED).groupBy("bucket").applyInPandas(_count_bucket(bits), "part int, a binary, n binary")
    counts = counts.groupBy("part").applyInPandas(_sum_part, "cls long, common long")
    classes = stage(rows.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.max("n").alias("n")), "join-classes")
    may = stage(classes.join(counts.hint("merge"), "cls").filter(F.col("common") >= 1 + F.floor(F.ceil(F.col("n") * 0.75) / 16)).select(F.col("first.doc_id").alias("rep"), "cls", "n"), "join-may")
    listed = stage(_sets_of(own, may, width), "join-sets")
    comp = connected_components(stage(_ties(listed, max(4, bits - 2), shared), "join-ties")).withColumnRenamed("node", "cls").withColumnRenamed("component", "comp")
    comp = stage(comp, "join-components")
    large = stage(comp.groupBy("comp").count().filter(F.col("count") > block).select("comp"), "join-large")
    whole = comp.join(large.hint("shuffle_hash"), "comp", "left_anti")
    links = _link(listed.join(whole.hint("merge"), "cls").select(F.col("comp").cast("string").alias("task"), "cls", "tokens", F.col("cls").alias("part")))
    if not large.isEmpty():
        cut = comp.join(large.hint("shuffle_hash"), "comp", "left_semi")
        links = links.unionByName(_link_large(stage(listed.join(cut.hint("merge"), "cls").dropDuplicates(["cls"]).select("cls", "comp", "n", "tokens"), "join-sets"), block))
    # classes have hashed names; components are named by the smallest document
    found = connected_components(stage(links, "join-links")).withColumnRenamed("node", "cls")
    group = stage(classes.join(found.hint("merge"), "cls", "left").select("cls", "first", F.coalesce("component", "cls").alias("component")), "join-groups")
    named = stage(group.groupBy("component").agg(F.min("first").alias("lead")), "join-named")
    down = stage(group.join(named.hint("merge"), "component").select("cls", "lead"), "join-leads")
    out = rows.join(down.hint("merge"), "cls", "left")
    return out.select(
        id_out("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), id_out(F.coalesce("lead.doc_id", "doc_id")).alias("component_id"),
        F.col("hash").alias("text_hash"), F.coalesce("lead.hash", "hash").alias("first_hash"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays: the one with the smallest id, of rows that share it the first by text hash.

    Rows without shingles all stay.
    """
    rows = near_components(docs, id_col, text_col)
    kept = rows.filter("n_shingles = 0 or (doc_id <=> component_id and text_hash = first_hash)")
    kept = kept.groupBy("doc_id", "text_hash").agg(((F.max("n_shingles") > 0) & (F.count("*") > 1)).alias("again"))
    return keep_rows(docs, kept, id_col, text_col)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
