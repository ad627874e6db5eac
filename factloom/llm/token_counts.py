"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, ahead of the scan, by
merging each of them: the string must be a possible stretch of split text, and merging
its characters must end in the string itself.  The proof is the same for every table, so
the proven strings (at most the vocabulary) are sent to the tasks.  There a text is cut
into stretches that no vocabulary entry spans; a proven stretch counts as one at the cost
of a look-up, and only the others are merged (their counts are kept in a bounded cache).

Counts are those of the model's own library, without begin, end or other added tokens;
special strings inside texts are ordinary text.

Defined results: null and empty texts have no token and no byte; whole texts of any
length; each row, repeated or with a null id, gets its own result; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, documents, own_cache, text_bytes
from .piece_codec import Codec, codec

LIMIT = 4096
#: Merged stretches that a worker remembers.
REMEMBERED = 300_000


def whole_tokens(own: Codec) -> list[str]:
    """The vocabulary strings that encode alone as one token."""
    return [p for p in own.ids if own.split.fullmatch(p) and own._merge_short(p) == [p]]


class Counts(dict):
    """Tokens of each stretch: proven ones from the start, the others when they are met."""

    def __init__(self, own: Codec, proven: Iterable[str]) -> None:
        super().__init__()
        self.own, self.proven = own, dict.fromkeys(proven, 1)

    def refill(self) -> None:
        if len(self) < len(self.proven) or len(self) > len(self.proven) + REMEMBERED:
            self.clear()
            self.update(self.proven)

    def __missing__(self, stretch: str) -> int:
        ids, _, _ = self.own._merged(stretch)
        n = len(ids) // 4
        if len(stretch) < 64:  # longer ones hardly return
            self[stretch] = n
        return n

    def of(self, text: bytes) -> int:
        norm, _ = self.own.normalise(text)
        return sum(map(self.__getitem__, self.own.split.findall(norm)))


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
COUNTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
_counts: dict[str | None, Counts] = {}


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, and whether there are more than ``limit`` tokens."""
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(codec(model)))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counts:
            _counts[model] = Counts(codec(model), proven.value)
        counts = _counts[model]
        own_cache("token counts", counts)
        for b in batches:
            counts.refill()
            texts = text_bytes(b.column("text"))
            n = [counts.of(t) for t in texts]
            yield batch(COUNTS_ARROW, {"doc_id": b.column("doc_id"), "n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, COUNTS)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
