"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all documents counts in how many each hashed word occurs (idf).
2. The benchmark's passages (windows of ``WINDOW`` words) become TF-IDF rows; a distributed
   randomised SVD (subspace iteration: tasks return their share of A'(A X), the driver
   orthonormalises a vocabulary-by-rank matrix of fixed size) gives the latent space.
3. One pass over all documents slides overlapping windows over each whole text and takes
   the cosine of every window with every passage in the latent space.  Each word adds at
   most a known amount to any passage's cosine; windows whose words can't reach a
   threshold together, first of any passage and then of a group of them, are skipped
   before they are projected, which loses nothing.
4. A candidate's surroundings are compared by longest common subsequence of words with
   the passage and with the whole item.  ``SURE`` of the words of either in order make a
   hit, so a verbatim piece of ``WINDOW`` words of a long item is one.  Less than that is
   a paraphrase if more speaks for it: from ``MAYBE`` of the item on its answer (a column,
   or else the last sentence, or of an item of one sentence the last quarter, ``MIN_WORDS``
   at least); or from ``HALF`` on, for items of ``TELLING`` words, a subsequence longer by
   ``CLEAR`` of the item than the one that the item read backwards has there.  Backwards
   the words are the same and their order means nothing, so that is the chance level of
   this very document.
5. Items of fewer than ``MIN_WORDS`` words count where their words stand side by side.

``common_words`` and ``item_words`` count the whole item, also where a passage made the hit.

The benchmark is a stated query set; it is taken ``ITEMS`` items or ``PASSAGES`` passages at
a time against all rows.  An item of more than ``LONG`` words is searched in pieces of
that many, each judged like an item; where it has more than ``PASSAGES`` passages it may
give a row for each block that holds a piece of it.  Only idf counts are shuffled.

Defined results: null and empty texts have no hit; items without a word never match; items of equal text each get their row; a
repeated document row gives repeated hits; null ids stay null; an empty documents or
benchmark table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, batch, documents, id_in, small_batches

BITS = 16
TERMS = 1 << BITS
WINDOW, STEP, PASSAGE_STEP = 32, 16, 8
RANK, EXTRA, ROUNDS = 256, 16, 2
#: Share of what a passage keeps in the latent space that a window has to reach.
NEAR = 0.3
SURE, MAYBE, ANSWER = 0.8, 0.6, 0.8
HALF, CLEAR, TELLING = 0.55, 0.25, 12
MIN_WORDS, ITEMS, PASSAGES, LONG = 5, 2048, 16_384, 4096

#: Passages are put into so many groups, each with its own bound of what a word can add.
GROUPS = 8
#: Bytes hashed, and words searched, at once.
PIECE, CHUNK = 1 << 20, 1 << 17

_WORD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_random = np.random.default_rng(23)
_VALUES, _WEIGHTS = _random.integers(1, 1 << 63, 256).astype(np.uint64), _random.integers(1, 1 << 63, 64).astype(np.uint64) | np.uint64(1)


def plain(text: str) -> bytes:
    """The text with words lowered and everything between them blank."""
    return text.lower().encode().translate(_WORD)


def words_of(text: str) -> list[bytes]:
    return plain(text).split()


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    letters = np.frombuffer(raw, np.uint8)
    inside = letters != 32
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts = edges[::2]
    if not len(starts):
        return starts, np.zeros(0, np.int32)
    size = edges[1::2] - starts
    first = np.cumsum(size) - size
    letters = letters[inside]
    place = np.arange(len(letters)) - np.repeat(first, size)
    h = np.add.reduceat(_VALUES[letters] * _WEIGHTS[place & 63], first)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return starts, (h >> np.uint64(64 - BITS)).astype(np.int32)


def terms_in(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a plain text."""
    starts, terms, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= PIECE else raw.rfind(b" ", at, at + PIECE)
        if end < 0:
            end = raw.find(b" ", at)
            end = len(raw) if end < 0 else end
        s, t = _hashed(raw[at:end])
        starts.append(s + at)
        terms.append(t)
        at = end + 1
    return np.concatenate(starts), np.concatenate(terms)


def terms_of(words: list[bytes]) -> np.ndarray:
    return terms_in(b" ".join(words))[1]


def terms_by_text(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of plain texts one after another, and how many each has."""
    size = np.array([len(r) + 1 for r in raws], np.int64)
    starts, terms = terms_in(b" ".join(raws))
    ends = np.searchsorted(starts, np.cumsum(size))
    return terms, np.diff(ends, prepend=0)


def inverse_frequency(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the term)) + 0.1 for each hashed term, over all documents."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TERMS + 1, np.int64)
        for b in batches:
            raws = [plain(t or "") for t in b.column(0).to_pylist()]
            counts[TERMS] += len(raws)
            terms, n = terms_by_text(raws)
            counts[:TERMS] += np.bincount(np.unique((np.repeat(np.arange(len(n)), n) << BITS) | terms) & (TERMS - 1), minlength=TERMS)
        used = np.flatnonzero(counts)
        yield batch(schema, {"term": used, "n": counts[used]})

    rows = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(TERMS + 1, np.int64)  # a row a term
    df[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return (np.log((1 + df[TERMS]) / (1 + df[:TERMS])) + 0.1).astype(np.float32)


@dataclass
class Index:
    """What the search needs; ``ITEMS``, ``PASSAGES`` and ``RANK`` bound its size."""

    items: list[tuple]  # pieces: id, words, words of the answer, the places of both, of the words backwards, the distinct words, the item's number and size
    short: dict[int, list[tuple]]  # term of the first word -> id, words, words of the answer, places of the answer
    idf2: np.ndarray
    vocabulary: np.ndarray  # term -> row of basis, or -1
    basis: np.ndarray  # weighted by idf
    passages: np.ndarray  # latent, length 1 before projection
    parts: list[tuple[frozenset, dict, int] | None]  # distinct words, places, size; None where the passage is the item
    owner: np.ndarray
    need: np.ndarray
    most: np.ndarray  # row of basis -> the largest share of any passage's threshold that one such word gives
    by_group: np.ndarray  # the same, for each group of passages and with its sign


def _answer(text: str, answer: str | None) -> list[bytes]:
    """Words of the given answer, or else of the last sentence, or else of the end of the only sentence."""
    if answer and (given := words_of(answer)):
        return given
    sentences = [w for s in re.split(r"[.!?\n]+", text) if (w := words_of(s))]
    if len(sentences) != 1:
        return sentences[-1] if sentences else []
    return sentences[0][-max(MIN_WORDS, len(sentences[0]) // 4) :]


def _passages(words: list[bytes]) -> list[tuple[int, int]]:
    last = max(0, len(words) - WINDOW)
    return [(s, min(s + WINDOW, len(words))) for s in sorted({*range(0, last, PASSAGE_STEP), last})]


def latent_basis(spark: SparkSession, rows: list[tuple[bytes, bytes]], width: int, seed: int = 11) -> np.ndarray:
    """Orthonormal columns that span the leading right singular space of the sparse rows (ids, values)."""
    rank = min(RANK, width, len(rows))
    table = spark.createDataFrame(rows, "ids binary, x binary").repartition(8).cache()
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(rank + EXTRA, width))))[0]

    def multiply(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x.astype(np.float32))
        schema = pa.schema([("ids", pa.binary()), ("part", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(shared.value.shape, np.float32)
            for b in batches:
                for ids, values in zip(b.column("ids").to_pylist(), b.column("x").to_pylist()):
                    k, v = np.frombuffer(ids, np.int32), np.frombuffer(values, np.float32)
                    np.add.at(own, k, v[:, None] * (v @ shared.value[k]))
            used = np.flatnonzero(own.any(axis=1)).astype(np.int32)
            yield batch(schema, {"ids": [used.tobytes()], "part": [own[used].tobytes()]})

        out = np.zeros(x.shape)
        for r in table.mapInArrow(run, "ids binary, part binary").toLocalIterator():  # eight parts
            out[np.frombuffer(r["ids"], np.int32)] += np.frombuffer(r["part"], np.float32).reshape(-1, x.shape[1])
        shared.unpersist()
        return out

    for _ in range(ROUNDS):
        x = np.linalg.qr(multiply(x))[0]
    small = x.T @ multiply(x)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    table.unpersist()
    return x @ vector[:, np.argsort(-value)[:rank]]


def pieces(words: list[bytes]) -> list[tuple[int, int]]:
    """Where an item is cut: whole up to ``LONG`` words, else pieces that overlap by a passage."""
    return [(s, min(s + LONG, len(words))) for s in range(0, max(1, len(words) - WINDOW), LONG - WINDOW)]


def build_index(spark: SparkSession, items: list[tuple], idf: np.ndarray) -> Index:
    """Of ``items``: (id, words of a piece, words of the answer, the item's number, its words in all)."""
    short: dict[int, list[tuple]] = {}
    for i, words, answer, _, size in items:
        if size < MIN_WORDS:
            short.setdefault(int(terms_of(words[:1])[0]), []).append((i, words, answer, places(answer)))
    kept = [x for x in items if x[4] >= MIN_WORDS]
    if not kept:
        nothing = np.zeros(0, np.float32)
        return Index([], short, idf**2, np.full(TERMS, -1, np.int32), nothing, nothing, [], nothing, nothing, nothing, nothing)
    vocabulary = np.full(TERMS, -1, np.int32)
    used = np.unique(np.concatenate([terms_of(x[1]) for x in kept]))
    vocabulary[used] = np.arange(len(used))
    rows, owner, sparse, parts = [], [], [], []
    for at, words in enumerate(x[1] for x in kept):
        terms = terms_of(words)
        for s, e in _passages(words):
            own, tf = np.unique(terms[s:e], return_counts=True)
            x = (tf * idf[own]).astype(np.float32)
            x /= np.sqrt((idf[terms[s:e]] ** 2).sum())
            sparse.append((vocabulary[own].astype(np.int32), x))
            rows.append((sparse[-1][0].tobytes(), x.tobytes()))
            owner.append(at)
            parts.append((frozenset(words[s:e]), places(words[s:e]), e - s) if e - s < len(words) else None)
    basis = latent_basis(spark, rows, len(used))
    passages = np.stack([x @ basis[ids] for ids, x in sparse]).astype(np.float32)
    held = np.sqrt((passages**2).sum(axis=1))
    need = (NEAR * held**2).astype(np.float32)
    weighted = np.vstack([basis * idf[used][:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    group = _groups(passages)
    by_group = np.zeros((len(weighted), group.max() + 1), np.float32)
    for a in range(0, len(weighted), 4096):
        share = weighted[a : a + 4096] @ (passages / need[:, None]).T
        for g in range(by_group.shape[1]):
            by_group[a : a + 4096, g] = share[:, group == g].max(axis=1)
    most = np.maximum(by_group, 0).max(axis=1)
    known = [(i, w, a, places(w), places(a), places(w[::-1]), frozenset(w), number, size) for i, w, a, number, size in kept]
    return Index(known, short, idf**2, vocabulary, weighted, passages, parts, np.array(owner), need, most, by_group)


def _groups(passages: np.ndarray, seed: int = 7) -> np.ndarray:
    """Group of each passage: a few rounds of spherical k-means."""
    n = min(GROUPS, len(passages))
    centre = passages[np.random.default_rng(seed).choice(len(passages), n, replace=False)]
    for _ in range(8):
        group = (passages @ centre.T).argmax(axis=1)
        centre = np.stack([passages[group == g].mean(axis=0) if (group == g).any() else centre[g] for g in range(n)])
        centre /= np.sqrt((centre**2).sum(axis=1, keepdims=True)) + 1e-9
    return np.unique(group, return_inverse=True)[1]


def places(item: list[bytes]) -> dict[bytes, int]:
    """Bit mask of each word's places."""
    out: dict[bytes, int] = {}
    for k, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << k
    return out


def common_words(place: dict[bytes, int], size: int, text: list[bytes]) -> int:
    """Length of the longest common subsequence with an item of ``size`` words, bit-parallel over the item."""
    full = v = (1 << size) - 1
    for m in [place[w] for w in text if w in place]:  # other words change nothing
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def candidates(index: Index, terms: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(text, window start, passage, cosine) of the windows that reach a passage's threshold, by text."""
    own = np.flatnonzero(counts)
    if not len(own) or not len(index.passages):
        return
    row = index.vocabulary[terms]
    whole = np.concatenate(([0.0], np.cumsum(index.idf2[terms], dtype=np.float64)))
    most = np.concatenate(([0.0], np.cumsum(index.most[row], dtype=np.float64)))
    n = counts[own]
    last = np.maximum(0, n - WINDOW)
    windows = -(-last // STEP) + 1
    text = np.repeat(np.arange(len(own)), windows)
    begin = (np.cumsum(counts) - counts)[own][text]
    at = np.minimum((np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)) * STEP, last[text])
    starts, ends = begin + at, begin + np.minimum(at + WINDOW, n[text])
    least = 0.999 * np.sqrt(np.maximum(whole[ends] - whole[starts], 1e-12))
    keep = np.flatnonzero(most[ends] - most[starts] >= least)
    for k in range(0, len(keep), 1024):
        some = keep[k : k + 1024]
        place = starts[some][:, None] + np.arange(WINDOW)
        rows = np.where(place < ends[some][:, None], row[np.minimum(place, len(row) - 1)], -1)
        near = np.flatnonzero(index.by_group[rows].sum(axis=1).max(axis=1) >= least[some])
        for j in range(0, len(near), 256):
            part = near[j : j + 256]
            z = index.basis[rows[part]].sum(axis=1) * (0.999 / least[some[part]])[:, None].astype(np.float32)
            cosine = z @ index.passages.T
            for w, p in zip(*(x.tolist() for x in np.nonzero(cosine >= index.need))):
                i = some[part[w]]
                yield int(own[text[i]]), int(at[i]), p, float(cosine[w, p])


def _holds_part(index: Index, passages: list[int], region: list[bytes]) -> bool:
    """Whether ``SURE`` of the words of one of the passages are there in order."""
    there: set[bytes] = set()
    for distinct, place, size in filter(None, map(index.parts.__getitem__, passages)):
        there = there or set(region)
        if size - len(distinct - there) >= SURE * size and common_words(place, size, region) >= SURE * size:
            return True
    return False


def hits_of(index: Index, words: list[bytes], near: list[tuple[int, int, float]]) -> list[tuple[int, float, int, int, bool, int]]:
    """(piece, cosine, common words, item words, answer found, first word of the window) of each item, from a text's candidates."""
    best: dict[int, tuple] = {}
    seen: dict[tuple[int, int], tuple[float, list[int]]] = {}
    for start, passage, cosine in near:
        key = int(index.owner[passage]), start
        most, own = seen.get(key, (0.0, []))
        seen[key] = max(cosine, most), [*own, passage]
    for (piece, start), (cosine, passages) in seen.items():
        _, own, answer, place, answer_place, back, distinct, item, size = index.items[piece]
        region = words[max(0, start - len(own)) : start + WINDOW + len(own)]
        there = set(region)
        # bounds of what is common, in any order
        whole = len(own) - len(distinct - there) >= HALF * len(own) and sum([w in there for w in own]) >= HALF * len(own)
        part = _holds_part(index, passages, words[max(0, start - WINDOW) : start + 2 * WINDOW])
        if not whole and not part:
            continue
        both = common_words(place, len(own), region)
        if item in best and both <= best[item][2]:
            continue
        found = common_words(answer_place, len(answer), region) >= ANSWER * len(answer) if answer else False
        if part or both >= SURE * len(own) or both >= MAYBE * len(own) and found or _above_chance(both, own, back, region):
            best[item] = (piece, cosine, both, size, found, start)
    return list(best.values())


def _above_chance(both: int, own: list[bytes], back: dict[bytes, int], region: list[bytes]) -> bool:
    """Whether the common words are clearly more than those of the item read backwards."""
    n = len(own)
    return n >= TELLING and both >= HALF * n and both - common_words(back, n, region) >= max(CLEAR * n, MIN_WORDS)


def verbatim(index: Index, terms: np.ndarray, counts: np.ndarray, raws: list[bytes]) -> Iterator[tuple[int, tuple]]:
    """(text, hit) of the short items whose words stand side by side, once a text."""
    if not index.short:
        return
    first = np.zeros(TERMS, bool)
    first[list(index.short)] = True
    begin = np.cumsum(counts) - counts
    at = np.flatnonzero(first[terms])
    for k, places_of in groupby(zip(np.searchsorted(begin, at, side="right") - 1, at), key=lambda x: x[0]):
        words, seen = raws[k].split(), set()
        for _, p in places_of:
            s = int(p - begin[k])
            for n, (i, own, answer, answer_place) in enumerate(index.short[int(terms[p])]):
                if (own[0], n) not in seen and words[s : s + len(own)] == own:
                    seen.add((own[0], n))
                    region = words[max(0, s - len(own)) : s + WINDOW + len(own)]
                    found = common_words(answer_place, len(answer), region) >= ANSWER * len(answer) if answer else False
                    yield int(k), (i, None, len(own), len(own), found, s)


HITS = "doc_id long, item_id long, cosine double, common_words int, item_words int, answer_found boolean, first_word int"
HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common_words", pa.int32()), ("item_words", pa.int32()), ("answer_found", pa.bool_()), ("first_word", pa.int32())])


def _search(docs: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def chunks(raws: list[bytes]) -> Iterator[tuple[int, int]]:
        first, size = 0, 0
        for k, raw in enumerate(raws):
            if k > first and size + len(raw) > 8 * CHUNK:
                yield first, k
                first, size = k, 0
            size += len(raw)
        yield first, len(raws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            rows: dict[str, list] = {f.name: [] for f in HITS_ARROW}
            ids, raws = b.column("doc_id").to_pylist(), [plain(t or "") for t in b.column("text").to_pylist()]
            for s, e in chunks(raws):
                terms, counts = terms_by_text(raws[s:e])
                found = list(verbatim(own, terms, counts, raws[s:e]))
                for k, near in groupby(candidates(own, terms, counts), key=lambda x: x[0]):
                    found += [(k, (own.items[piece][0], *rest)) for piece, *rest in hits_of(own, raws[s + k].split(), [x[1:] for x in near])]
                for k, hit in found:
                    for name, v in zip(HITS_ARROW.names, (ids[s + k], *hit)):
                        rows[name].append(v)
            yield batch(HITS_ARROW, rows)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, HITS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that the document holds or paraphrases."""
    spark = docs.sparkSession
    small_batches(spark)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    idf, out, block, held, number = inverse_frequency(docs, text_col), None, [], 0, 0

    def search() -> DataFrame:
        found = _search(docs, build_index(spark, block, idf), id_col, text_col)
        return found if out is None else out.unionByName(found)

    for r in items.orderBy("item_id", "text").toLocalIterator():  # a block at a time on the driver
        words = words_of(r["text"])
        if not words:
            continue
        answer, number = _answer(r["text"], r["answer"]), number + 1
        for s, e in pieces(words):
            block.append((r["item_id"], words[s:e], answer[:LONG], number, len(words)))
            held += -(-(e - s) // PASSAGE_STEP)
            if len(block) >= ITEMS or held >= PASSAGES:
                out, block, held = search(), [], 0
    if block:
        out = search()
    return out if out is not None else spark.createDataFrame([], HITS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item."""
    bad = find_leaks(docs, benchmark, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_keep_id")).distinct()
    return docs.join(bad.hint("shuffle_hash"), id_in(docs[id_col]) == bad["_keep_id"], "left_anti").select(*[docs[c] for c in docs.columns])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
