"""Language ID by unigrams marginalised over all segmentations.

The pieces of a fixed public vocabulary (a model file; its path is a parameter) have one
probability per language.  A word's probability in a language is the sum, over every way
to cut it into pieces, of the product of their probabilities; the forward algorithm gives
it in one pass.  A text's is the product over its words.  Piece probabilities are fitted
by expectation-maximisation over all segmentations of the training words: tasks run the
forward-backward pass over their share of the (language, word, count) table, Spark sums
expected counts by piece, and only vocabulary x languages numbers reach the driver.

Learned from a bounded sample: the ``max_train`` documents with a language whose id has the
smallest hash, whole texts with words of any length: in a script without blanks a word is
a sentence.  Every document is scored, whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows
whose language is null are never learned from; ties go to the first language by name;
a language whose sampled texts have no word has nothing to learn from and is never
predicted; without any training row every text is ``und``; each row, repeated or with a null id, gets
its own result; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, stage
from .piece_codec import SPACE, default_model

MAX_TRAIN = 6000
ROUNDS = 3
#: Probability of a letter that no piece has.
UNKNOWN = 1e-7
SHORT = 30
CHUNK = 1 << 20

#: ASCII bytes that aren't letters become blanks, A-Z become a-z.
_FOLD = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def words_of(text: str) -> list[str]:
    return text.encode().translate(_FOLD).decode().lower().split()


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text.encode())) or (not text.isascii() and any(map(str.isalpha, text)))


class Pieces:
    """Vocabulary as prefixes: piece -> id, mere prefix -> -1."""

    def __init__(self, model: str | None = None) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model or default_model(), "rb") as f:
            proto.ParseFromString(f.read())
        own = sorted({p.piece.lower() for p in proto.pieces if p.type in (1, 4)})
        self.size = len(own)
        self.ids: dict[str, int] = {}
        for k, p in enumerate(own):
            for n in range(1, len(p)):
                self.ids.setdefault(p[:n], -1)
            self.ids[p] = k
        self.longest = max(map(len, own))

    def edges(self, word: str, first: int = 0, last: int | None = None) -> list[tuple[int, int, int]]:
        """(start, end, piece) of every piece in the word; a letter that none has gets one with id -1.
        With ``first`` and ``last`` those that start in this range."""
        ids, n, longest, out = self.ids, len(word), self.longest, []
        for i in range(first, n if last is None else last):
            found = False
            for j in range(i + 1, min(n, i + longest) + 1):
                k = ids.get(word[i:j])
                if k is None:
                    break
                if k >= 0:
                    out.append((i, j, k))
                    found = found or j == i + 1
            if not found:
                out.append((i, i + 1, -1))
        return out


_pieces: dict[str | None, Pieces] = {}


def pieces(model: str | None) -> Pieces:
    if model not in _pieces:
        _pieces[model] = Pieces(model)
    return _pieces[model]


def expected_counts(word: str, p: np.ndarray | list, vocab: Pieces) -> tuple[float, list[tuple[int, float]]]:
    """Forward-backward over one word: its probability and each piece's expected number of uses."""
    if len(word) > SHORT:
        return _expected_long(word, p, vocab)
    n, edges = len(word), vocab.edges(word)
    ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j, k in edges:  # by start, so each start is complete when it is read
        ahead[j] += ahead[i] * (p[k] if k >= 0 else UNKNOWN)
    for i, j, k in reversed(edges):
        back[i] += back[j] * (p[k] if k >= 0 else UNKNOWN)
    whole = ahead[n]
    if whole <= 0.0:
        return 0.0, []
    return whole, [(k, ahead[i] * p[k] * back[j] / whole) for i, j, k in edges if k >= 0]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b


def _expected_long(word: str, p: np.ndarray | list, vocab: Pieces) -> tuple[float, list[tuple[int, float]]]:
    """The same in logarithms, for words of any length; edges are found anew in each direction instead of held."""
    n = len(word)
    ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i in range(n):
        for _, j, k in vocab.edges(word, i, i + 1):
            ahead[j] = _log_add(ahead[j], ahead[i] + math.log(max(p[k], 1e-300) if k >= 0 else UNKNOWN))
    uses: dict[int, float] = {}
    for i in reversed(range(n)):
        for _, j, k in vocab.edges(word, i, i + 1):
            own = back[j] + math.log(max(p[k], 1e-300) if k >= 0 else UNKNOWN)
            back[i] = _log_add(back[i], own)
            if k >= 0:
                uses[k] = uses.get(k, 0.0) + math.exp(ahead[i] + own - ahead[n])
    return math.exp(ahead[n]), list(uses.items())


class Scorer:
    """Log-probabilities of words by language, remembered for words seen lately."""

    def __init__(self, table: np.ndarray, vocab: Pieces, limit: int = 300_000) -> None:
        self.p = np.vstack([table, np.full((1, table.shape[1]), UNKNOWN)])  # the last row serves id -1
        self.vocab, self.limit = vocab, limit
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((1024, table.shape[1]), np.float32)

    def _learn(self, words: list[str]) -> None:
        if len(self.rows) + len(words) > self.limit:
            self.rows = {}
        at = len(self.rows)
        while at + len(words) > len(self.logs):
            self.logs = np.vstack([self.logs, np.zeros_like(self.logs)])
        self.logs[at : at + len(words)] = self.forward(words)
        self.rows.update(zip(words, range(at, at + len(words))))

    def forward(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.p.shape[1]))
        short = [m for m, w in enumerate(words) if len(w) < SHORT]
        edges = [(j, m, i, k) for m in short for i, j, k in self.vocab.edges(SPACE + words[m])]
        if edges:
            e = np.array(edges, np.int64)
            e = e[np.lexsort((e[:, 1], e[:, 0]))]
            alpha = np.zeros((SHORT + 1, len(words), self.p.shape[1]))
            alpha[0] = 1.0
            ends = np.searchsorted(e[:, 0], np.arange(SHORT + 2))
            for j in range(1, SHORT + 1):
                part = e[ends[j] : ends[j + 1]]
                if len(part):
                    first = np.flatnonzero(np.concatenate(([True], part[1:, 1] != part[:-1, 1])))
                    alpha[j, part[first, 1]] = np.add.reduceat(alpha[part[:, 2], part[:, 1]] * self.p[part[:, 3]], first)
            m = np.array(short)
            out[m] = np.log(alpha[[len(words[k]) + 1 for k in short], m] + 1e-300)
        for m, w in enumerate(words):
            if len(w) >= SHORT:
                out[m] = self._forward_long(SPACE + w)
        return out

    def _forward_long(self, word: str) -> np.ndarray:
        """The same with rescaling, for words of any length."""
        span = self.vocab.longest + 1
        alpha = np.zeros((span, self.p.shape[1]))
        alpha[0] = 1.0
        scale = np.zeros(self.p.shape[1])
        ids, n = self.vocab.ids, len(word)
        for i in range(n):
            now = alpha[i % span].copy()
            alpha[i % span] = 0.0
            top = np.maximum(now, 1e-300)
            alpha /= top
            scale += np.log(top)
            found = False
            for j in range(i + 1, min(n, i + self.vocab.longest) + 1):
                k = ids.get(word[i:j])
                if k is None:
                    break
                if k >= 0:
                    alpha[j % span] += self.p[k]
                    found = found or j == i + 1
            if not found:
                alpha[(i + 1) % span] += UNKNOWN
        return scale + np.log(np.maximum(alpha[n % span], 1e-300))

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """Log-probability of each text, by language."""
        missing = list({w for words in texts for w in words if w not in self.rows})
        if len(self.rows) + len(missing) > self.limit:
            missing = list({w for words in texts for w in words})
        if missing:
            self._learn(missing)
        counts = np.array([len(t) for t in texts])
        at = np.fromiter((self.rows[w] for words in texts for w in words), np.int64, int(counts.sum()))
        sums = np.zeros((len(texts), self.p.shape[1]))
        full = np.flatnonzero(counts)
        if len(full):
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
            sums[full] = np.add.reduceat(self.logs[at].astype(np.float64), starts)
        return sums


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, rounds: int = ROUNDS, model: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and the piece probabilities, one column a language."""
    spark = docs.sparkSession
    named = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & docs[id_col].isNotNull())
    sample = named.select(F.col(id_col).cast("long").alias("_doc"), F.col(lang_col).cast("string").alias("_lang")).orderBy(F.xxhash64("_doc"), "_doc").limit(max_train)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
        for b in batches:
            seen: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.update((lang, w) for w in words_of(text))
            yield batch(schema, {"lang": [k[0] for k in seen], "word": [k[1] for k in seen], "n": list(seen.values())})

    own = named.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    picked = own.join(F.broadcast(sample.distinct()), (F.col("doc_id") == F.col("_doc")) & (F.col("lang") == F.col("_lang")))  # an id may occur with several languages
    table = stage(picked.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    size = pieces(model).size
    p = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds if langs else 0):
        p = _round(spark, table, langs, p, model)
    return langs, p


def _round(spark: SparkSession, table: DataFrame, langs: list[str], p: np.ndarray, model: str | None) -> np.ndarray:
    shared = spark.sparkContext.broadcast(p.astype(np.float32))  # vocabulary x languages
    column = {lang: k for k, lang in enumerate(langs)}

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, by_lang, total = pieces(model), {}, {}
        for b in batches:
            for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n"))):
                if lang not in by_lang:
                    by_lang[lang] = shared.value[:, column[lang]].tolist()
                own, sums = by_lang[lang], total.setdefault(lang, {})
                for k, uses in expected_counts(SPACE + word, own, vocab)[1]:
                    sums[k] = sums.get(k, 0.0) + uses * n
        schema = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("uses", pa.float64())])
        for lang, sums in total.items():
            yield batch(schema, {"lang": [lang] * len(sums), "piece": list(sums), "uses": list(sums.values())})

    rows = table.mapInArrow(expect, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum(F.round("uses", 6)).alias("uses")).collect()
    counts = np.full(p.shape, 0.01)
    for r in rows:
        counts[r["piece"], column[r["lang"]]] += r["uses"]
    shared.unpersist()
    return counts / counts.sum(axis=0)


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score (the posterior under equal priors): one row per row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(p)  # vocabulary x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, pieces(model)) if langs else None
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids, at = b.column("doc_id").to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                known = [scorer is not None and has_letter(t) for t in texts[at:end]]
                if scorer is None:
                    pred, score = ["und"] * (end - at), [0.0] * (end - at)
                else:
                    z = scorer.texts([words_of(t) if k else [] for t, k in zip(texts[at:end], known)])
                    z = np.exp(z - z.max(axis=1, keepdims=True))
                    z /= z.sum(axis=1, keepdims=True)
                    best = z.argmax(axis=1)
                    pred = [langs[c] if k else "und" for c, k in zip(best.tolist(), known)]
                    score = np.where(known, z[np.arange(len(z)), best], 0.0)
                yield batch(schema, {"doc_id": ids[at:end], "lang_pred": pred, "score": score})
                at = end

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    langs, p = train(docs.filter(~held))
    return identify(docs, langs, p).select("doc_id", held.alias("held_out"), "lang_pred", "score")
