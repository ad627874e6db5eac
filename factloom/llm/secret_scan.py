"""Secret scans by one combined deterministic automaton.

All rules are compiled together: each regex becomes a Thompson NFA with a loop in front,
subset construction over byte classes gives one DFA for all rules, Moore refinement
minimises it, and the result is a transition array with a bit mask of accepting rules
for each state.  A batch of texts is joined with a byte that no rule can cross and read
once: thousands of equal stretches step through the array side by side, and a stretch
whose true first state differs from the guessed one is stepped again until both agree.

An accepting byte only says where a match ends.  Its start comes from the rule's reversed
automaton and its end from the rule's own automaton, so spans are leftmost, as long as
the rule allows, and don't overlap within a rule, as ``re.finditer`` would give them.

Defined results: null and empty texts have no spans; very long texts are read whole;
each row, repeated or with a null id, gets its own result; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, documents, text_bytes

#: Never part of UTF-8, and no rule has it.
SEPARATOR = 0xFF


@dataclass(frozen=True)
class Rule:
    """A match shorter than ``min_length``, or whose assigned value is shorter than ``min_value``, is dropped but stays consumed.

    A length in the pattern itself multiplies the states of the other rules, so only the
    hex rule, which nearly every byte would start, has one there.
    """

    kind: str
    pattern: str
    ignore_case: bool = False
    min_length: int = 0
    min_value: int = 0


#: The base rules; the others add spans.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, min_value=6),
    Rule("access", r"AKIA[A-Z0-9]+", min_length=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]+", min_length=34),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", min_length=15),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", min_length=40),
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
)


# --- regex -> NFA ------------------------------------------------------------------

class _Nfa:
    """Thompson fragments.  ``moves``: (state, 256-bit class as a Python set, next)."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1

    def build(self, node: tuple, backward: bool) -> tuple[int, int]:
        kind, a, b = node[0], self.state(), self.state()
        if kind == "set":
            self.moves[a].append((node[1], b))
        elif kind == "cat":
            at = a
            for part in reversed(node[1]) if backward else node[1]:
                s, e = self.build(part, backward)
                self.eps[at].append(s)
                at = e
            self.eps[at].append(b)
        elif kind == "alt":
            for part in node[1]:
                s, e = self.build(part, backward)
                self.eps[a].append(s)
                self.eps[e].append(b)
        else:
            _, part, low, high = node
            at = a
            for k in range(low if high is None else high):
                if k >= low:
                    self.eps[at].append(b)
                s, e = self.build(part, backward)
                self.eps[at].append(s)
                at = e
            if high is None:
                s, e = self.build(part, backward)
                self.eps[at].append(s)
                self.eps[e].append(s)
                self.eps[e].append(b)
            self.eps[at].append(b)
        return a, b


def parse(pattern: str, ignore_case: bool) -> tuple:
    """Literals, ``\\xHH`` and escapes, classes, groups, ``|``, ``? * + {m} {m,} {m,n}``."""
    at = 0

    def one() -> int:
        nonlocal at
        if pattern[at] != "\\":
            at += 1
            return ord(pattern[at - 1])
        if pattern[at + 1] == "x":
            at += 4
            return int(pattern[at - 2 : at], 16)
        at += 2
        return ord(pattern[at - 1])

    def folded(chars: set[int]) -> frozenset[int]:
        return frozenset(chars | {ord(f(chr(c))) for c in chars if chr(c).isascii() for f in (str.lower, str.upper)} if ignore_case else chars)

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = alternatives()
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            chars: set[int] = set()
            while pattern[at] != "]":
                low = one()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    chars |= set(range(low, one() + 1))
                else:
                    chars.add(low)
            at += 1
            return ("set", folded(chars))
        return ("set", folded({one()}))

    def sequence() -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            part = atom()
            if at < len(pattern) and pattern[at] in "?*+{":
                mark = pattern[at]
                at += 1
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[mark]
                if mark == "{":
                    end = pattern.index("}", at)
                    first, _, second = pattern[at:end].partition(",")
                    low = int(first)
                    high = low if "," not in pattern[at:end] else int(second) if second else None
                    at = end + 1
                part = ("rep", part, low, high)
            parts.append(part)
        return ("cat", parts)

    def alternatives() -> tuple:
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    return alternatives()


# --- NFA -> minimal DFA ------------------------------------------------------------

@dataclass
class Dfa:
    """next = table[state, classes[byte]]; state 0 is the first; mask: bits of the rules accepted in a state."""

    table: np.ndarray
    classes: np.ndarray
    mask: np.ndarray

    def rows(self) -> list[list[int]]:
        return self.table[:, self.classes].tolist()

    def dead(self) -> int:
        """The state that no match leaves; -1 if there is none."""
        stuck = np.flatnonzero((self.table == np.arange(len(self.table))[:, None]).all(axis=1) & (self.mask == 0))
        return int(stuck[0]) if len(stuck) else -1


def determinise(rules: tuple[Rule, ...], search: bool, backward: bool = False) -> Dfa:
    """Subset construction over byte classes, then minimisation.  ``search``: matches may begin anywhere."""
    nfa = _Nfa()
    ends, first = {}, nfa.state()
    for k, rule in enumerate(rules):
        s, e = nfa.build(parse(rule.pattern, rule.ignore_case), backward)
        nfa.eps[first].append(s)
        ends[e] = 1 << k
    used = list({m[0] for state in nfa.moves for m in state})
    marks: dict[tuple, int] = {}
    classes = np.array([marks.setdefault(tuple(b in u for u in used), len(marks)) for b in range(256)], np.int64)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(marks))]

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for n in nfa.eps[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(s for s in seen if nfa.moves[s] or s in ends)

    start = closure({first})
    ids, order, table = {start: 0}, [start], []
    for subset in order:  # grows while it is read
        row = []
        for b in sample:
            to = {n for s in subset for chars, n in nfa.moves[s] if b in chars}
            nxt = closure(to) | (start if search else frozenset())
            if nxt not in ids:
                ids[nxt] = len(order)
                order.append(nxt)
            row.append(ids[nxt])
        table.append(row)
    grid = np.array(table, np.int64)
    mask = np.array([sum({ends[s] for s in subset if s in ends}) for subset in order], np.int64)
    group = np.unique(mask, return_inverse=True)[1].reshape(-1)
    while True:  # Moore: split groups until their members move alike
        _, new = np.unique(np.column_stack([group, group[grid]]), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == group.max():
            break
        group = new
    # number the groups by first appearance, so the first state stays 0
    lead = {g: i for i, g in enumerate(dict.fromkeys(group.tolist()))}
    group = np.array([lead[g] for g in group.tolist()])
    pick = np.array([int(np.flatnonzero(group == g)[0]) for g in range(len(lead))])
    return Dfa(group[grid[pick]], classes, mask[pick])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES, lane: int = 1024) -> None:
        self.rules, self.lane = rules, lane
        self.all = determinise(rules, True)
        self.flat = self.all.table.astype(np.int32).reshape(-1)
        self.width = self.all.table.shape[1]
        self.own = [(determinise((r,), False), determinise((r,), True), determinise((r,), False, True)) for r in rules]
        self.dead = [tuple(d.dead() for d in three) for three in self.own]
        self.own_rows = [tuple(d.rows() for d in three) for three in self.own]

    def accepts(self, data: np.ndarray) -> np.ndarray:
        """Mask of the rules that some match ends with at each byte."""
        n, lane = len(data), self.lane
        lanes = -(-n // lane)
        if not n:
            return np.zeros(0, np.int64)
        cls = np.full(lanes * lane, self.all.classes[SEPARATOR], np.int32)
        cls[:n] = self.all.classes[data]
        cls = np.ascontiguousarray(cls.reshape(lanes, lane).T)
        states = np.empty((lane, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for k in range(lane):
            state = self.flat[state * self.width + cls[k]]
            states[k] = state
        last = int(states[-1, 0])
        for j in range(1, lanes):  # a lane began in state 0; where that was wrong, step until it makes no difference
            if last:
                s = last
                for k in range(lane):
                    s = int(self.flat[s * self.width + cls[k, j]])
                    if s == states[k, j]:
                        break
                    states[k, j] = s
            last = int(states[-1, j])
        return self.all.mask[states.T.reshape(-1)[:n]]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, end, rule) in bytes for each text, kept ones only, ordered by start and rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        sep = bytes([SEPARATOR])
        data = sep.join(texts) + sep
        mask = self.accepts(np.frombuffer(data, np.uint8))
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        for k, rule in enumerate(self.rules):
            hits = np.flatnonzero(mask & (1 << k))
            if not len(hits):
                continue
            cuts = np.flatnonzero(np.diff(hits) > 1) + 1
            firsts, lasts = hits[np.concatenate(([0], cuts))], hits[np.concatenate((cuts - 1, [len(hits) - 1]))]
            whose = np.searchsorted(bounds, firsts, side="right") - 1
            done: dict[int, int] = {}
            for first, last, d in zip(firsts.tolist(), lasts.tolist(), whose.tolist()):
                base = int(bounds[d])
                text = texts[d]
                self._resolve(k, rule, text, first - base, last - base, done, d, out[d])
        for found in out:
            found.sort(key=lambda x: (x[0], x[2]))
        return out

    def _resolve(self, k: int, rule: Rule, text: bytes, first: int, last: int, done: dict[int, int], d: int, found: list) -> None:
        ahead, search, back = self.own_rows[k]
        accept_a, accept_s, accept_b = (x.mask for x in self.own[k])
        dead_a, _, dead_b = self.dead[k]
        floor, hit = done.get(d, 0), first
        while floor <= last:
            start = None
            if hit is not None and hit >= floor:
                state = 0
                for at in range(hit, floor - 1, -1):
                    state = back[state][text[at]]
                    if accept_b[state]:
                        start = at
                    elif state == dead_b:
                        break
            if start is not None:
                state, end = 0, None
                for at in range(start, len(text)):
                    state = ahead[state][text[at]]
                    if accept_a[state]:
                        end = at + 1
                    elif state == dead_a:
                        break
                if end - start >= rule.min_length and (not rule.min_value or self._value_length(text, start, end) >= rule.min_value):
                    found.append((start, end, k))
                done[d] = floor = end
            # the next accepting byte of a search that begins at the floor
            state, hit = 0, None
            for at in range(floor, last + 1):
                state = search[state][text[at]]
                if accept_s[state]:
                    hit = at
                    break
            if hit is None:
                return

    @staticmethod
    def _value_length(text: bytes, start: int, end: int) -> int:
        """Length of the assigned value: after the first separator, blanks and one quote."""
        at = start
        while text[at : at + 1] not in (b":", b"="):
            at += 1
        at += 1
        while text[at : at + 1] == b" ":
            at += 1
        if text[at : at + 1] in (b'"', b"'"):
            at += 1
        return end - at


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
#: Bytes of text that one pass reads at once.
CHUNK = 4 << 20
def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[a]), int(before[b]), k) for a, b, k in spans]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans: one row per row of ``docs``."""

    scan = Scanner(rules)  # compiled once; its size depends on the rules alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), text_bytes(b.column("text"))
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                rows: dict[str, list] = {f.name: [] for f in ARROW}
                for i, text, spans in zip(ids[at:end], texts[at:end], scan.spans(texts[at:end])):
                    named = [(rules[k].kind, s, e) for s, e, k in code_points(text, spans)]
                    base = [x for x in named if x[0] in BASE]
                    rows["doc_id"].append(i)
                    for kind in BASE:
                        rows[f"n_{kind}"].append(sum(x[0] == kind for x in base))
                    rows["base_sha256"].append(hashlib.sha256(",".join("%s:%d:%d" % x for x in base).encode()).hexdigest() if base else empty)
                    rows["spans"].append(",".join("%s:%d:%d" % x for x in named))
                yield batch(ARROW, rows)
                at = end

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, OUT)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
