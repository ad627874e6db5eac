"""SentencePiece encoding and decoding that keeps source offsets.

Encoding first normalises: at each place the longest prefix that the model's compiled
character map knows (a double-array trie) is replaced, other characters stay, blanks
become U+2581, and every normalised byte records the source byte that it came from.
Byte-pair merging then works on pieces of text that no vocabulary entry can span, so
each distinct one is merged once and remembered (in a bounded two-generation cache).
Piece lengths summed over the normalised text and looked up in the alignment give the
exact span of source bytes of every piece: spans are in order, don't overlap, and cover
the text.  Decoding joins pieces, turns U+2581 into blanks and byte pieces into text.

Vocabulary and rules come from the model file; its path is a parameter.

Defined results: null and empty texts have no piece (but the end id, where asked for)
and decode to the empty text; whole texts of any length; each row, repeated or with a
null id, gets its own result; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, documents, own_cache, small_batches, text_bytes

SPACE = "▁"
NONE = float("-inf")


def default_model() -> str:
    if "/opt/tokenizers" not in sys.path:
        sys.path.append("/opt/tokenizers")
    try:
        import public_tokenizers

        return public_tokenizers.path("piece_bpe_32k.model")
    except ImportError:
        return "/opt/tokenizers/piece_bpe_32k.model"


class CharMap:
    """Compiled character map: trie size, double-array units, then zero-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units: list[int] = []
        self.texts = b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
            self.texts = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest known prefix of ``text[at:]``."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._offset(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (self.texts[value : self.texts.index(b"\0", value)], k + 1 - at)
        return found


class _Segments(dict):
    """Merged pieces of each stretch of text: (ids, normalised lengths, ids as text)."""

    def __init__(self, merge, limit: int = 150_000) -> None:
        super().__init__()
        self.merge, self.limit, self.old = merge, limit, {}

    def clear(self) -> None:
        super().clear()
        self.old = {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.merge(key)
        if len(key) < 64:  # longer ones hardly return
            if len(self) >= self.limit:
                old = dict(self)
                self.clear()
                self.old = old
            self[key] = value
        return value


class Codec:
    def __init__(self, model: str | None = None) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model or default_model(), "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2:
            raise ValueError("only byte-pair models")
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (1, 4, 5)}
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type in (1, 4, 5)}
        self.unk = next(k for k, p in enumerate(proto.pieces) if p.type == 2)
        self.end = next(k for k, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == 6}
        self.names = [str(k) for k in range(len(proto.pieces))]
        self.info = {p: self._info(k, len(p.encode())) for p, k in self.ids.items()}
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else proto.trainer_spec.unk_surface.encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.blank_first = [p.type in (1, 4, 5) and p.piece.startswith(SPACE) for p in proto.pieces]
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "".join(c for c in "\n\r\t" if not any(c in p and len(p) > 1 for p in self.ids))
        if inner:
            self.split = re.compile(r"(?s).+")
        else:  # no entry runs on into a blank, or over a lone control character
            self.split = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self.segments = _Segments(self._merged)

    # --- normalisation ---------------------------------------------------------

    def normalise(self, text: bytes) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes and its end the source byte.

        A model whose character map is empty, as that of the query, only turns blanks into
        another character; that is done here at once, to the same result as by prefixes.
        """
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze and self.escape:
            source = np.frombuffer(text, np.uint8)
            width = np.where(source == 32, 3, 1)
            at = np.repeat(np.arange(len(text)), width)
            lead = [0, 0, 0] if self.dummy else []
            norm = text.decode().replace(" ", SPACE)
            return (SPACE + norm if self.dummy else norm), np.concatenate((lead, at, [len(text)])).astype(np.int64)
        return self._normalise_by_prefix(text)

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        found = self.map.longest(text, at)
        if found:
            return found
        end = at + 1
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        return text[at:end], end - at

    def _normalise_by_prefix(self, text: bytes) -> tuple[str, np.ndarray]:
        blank = SPACE.encode() if self.escape else b" "
        out, align, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(text):
                piece, size = self._prefix(text, at)
                if piece != b" ":
                    break
                at += size
            if at == len(text):
                return "", np.array([at], np.int64)
        if self.dummy:
            out += blank
            align += [at] * len(blank)
        after_blank = self.squeeze
        while at < len(text):
            piece, size = self._prefix(text, at)
            if after_blank:
                piece = piece.lstrip(b" ")
            if piece:
                for byte in piece:
                    put = blank if byte == 32 else bytes([byte])
                    out += put
                    align += [at] * len(put)
                after_blank = self.squeeze and piece.endswith(b" ")
            at += size
        end = at
        if self.squeeze:
            while out.endswith(blank):
                del out[-len(blank) :]
                end = align[len(out)]
                del align[len(out) :]
        return out.decode(), np.array(align + [end], np.int64)

    # --- merging ---------------------------------------------------------------

    def _merged(self, text: str) -> tuple[bytes, bytes, str]:
        """Little-endian 32-bit ids and sizes, and the ids as text."""
        parts = self._merge_short(text) if len(text) <= 96 else self._merge_long(text)
        info = self.info
        try:
            rows = [info[p] for p in parts]
        except KeyError:
            rows = [r for p in parts for r in ([info[p]] if p in info else self._unknown(p))]
        if len(rows) == 1:
            return rows[0]
        ids, sizes, names = zip(*rows)
        return b"".join(ids), b"".join(sizes), " ".join(names)

    def _unknown(self, part: str) -> list[tuple[bytes, bytes, str]]:
        raw = part.encode()
        if self.byte_ids:
            return [self._info(self.byte_ids[b], 1) for b in raw]
        return [self._info(self.unk, len(raw))]

    def _info(self, k: int, size: int) -> tuple[bytes, bytes, str]:
        return k.to_bytes(4, "little"), size.to_bytes(4, "little"), self.names[k]

    def _merge_short(self, text: str) -> list[str]:
        parts, score = list(text), self.score
        pairs = [score[p] if p in score else NONE for p in map(str.__add__, parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == NONE:
                break
            i = pairs.index(best)
            merged = parts[i] + parts.pop(i + 1)
            parts[i] = merged
            del pairs[i]
            if i:
                p = parts[i - 1] + merged
                pairs[i - 1] = score[p] if p in score else NONE
            if i < len(pairs):
                p = merged + parts[i + 1]
                pairs[i] = score[p] if p in score else NONE
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same with a heap and links, for long stretches."""
        part: list[str | None] = list(text)
        n, score = len(part), self.score.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n:
                s = score(part[i] + part[j])
                if s is not None:
                    heapq.heappush(heap, (-s, i, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in part if p is not None]

    # --- encoding and decoding -------------------------------------------------

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, str]:
        """ids, the source byte at which each piece ends, and the ids as text; a piece starts where the last ended."""
        norm, align = self.normalise(text)
        seg = self.segments
        rows = [seg[w] for w in self.split.findall(norm)]
        if not rows:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), ""
        ids, sizes, names = zip(*rows)
        return np.frombuffer(b"".join(ids), "<i4"), align[np.cumsum(np.frombuffer(b"".join(sizes), "<i4"))], " ".join(names)

    def decode(self, ids: list[int]) -> str:
        joined = b"".join([self.raw[k] for k in ids])
        first = next((k for k in ids if self.raw[k]), None)
        if self.dummy and first is not None and self.blank_first[first]:
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            out = []
            at = 0
            while at < len(joined):
                size = next((n for n in range(1, 5) if _valid(joined[at : at + n])), 0)
                out.append(joined[at : at + size].decode() if size else "�")
                at += size or 1
            return "".join(out)


def _valid(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_codecs: dict[str | None, Codec] = {}


def codec(model: str | None = None) -> Codec:
    """One codec a worker process."""
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


SPANS = "doc_id long, ids array<int>, starts array<long>, ends array<long>"
SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def encode_spans(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids of each text, and the half-open span of source bytes of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        own_cache("pieces", own.segments)
        for b in batches:
            rows: dict[str, list] = {f.name: [] for f in SPANS_ARROW}
            for i, text in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
                ids, ends, _ = own.encode(text)
                rows["doc_id"].append(i)
                rows["ids"].append(ids)
                rows["starts"].append(np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends)
                rows["ends"].append(ends)
            yield batch(SPANS_ARROW, rows)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SPANS)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_crc32 long"
DIGESTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ends_crc32", pa.int64())])


def encode_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids with an end id, of the decoded text, and of the pieces' source ends (little-endian 64-bit)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        own_cache("pieces", own.segments)
        end = str(own.end)
        for b in batches:
            rows: dict[str, list] = {f.name: [] for f in DIGESTS_ARROW}
            for i, text in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
                ids, ends, names = own.encode(text)
                names = f"{names} {end}" if names else end
                rows["doc_id"].append(i)
                rows["n_tokens"].append(len(ids) + 1)
                rows["ids_sha256"].append(hashlib.sha256(names.encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(own.decode([*ids.tolist(), own.end]).encode()).hexdigest())
                rows["ends_crc32"].append(zlib.crc32(ends.astype("<i8").tobytes()))
            yield batch(DIGESTS_ARROW, rows)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, DIGESTS)


def op3_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))
