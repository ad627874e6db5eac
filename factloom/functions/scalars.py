"""Column functions: names, tokens, hashes, phrases, profiles.  All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def type_of(c: str | Column) -> Column:
    """``Type`` of ``Type:name``, cut at the first colon; ``Unknown`` without one."""
    c = _c(c)
    return F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", 1)).otherwise("Unknown")


def name_of(c: str | Column) -> Column:
    """``name`` of ``Type:name``; the whole text without a colon."""
    c = _c(c)
    return F.when(F.instr(c, ":") > 0, F.substr(c, F.instr(c, ":") + 1)).otherwise(c)


def split_typed_id(c: str | Column) -> Column:
    return F.struct(type_of(c).alias("type"), name_of(c).alias("name"))


def split_endpoint(c: str | Column, verbs: Sequence[str] = vocab.VERBS) -> Column:
    """(method, path) of ``VERB path`` for known verbs, else (``UNKNOWN``, whole text)."""
    c = _c(c)
    pattern = f"^({'|'.join(verbs)}) (.*)$"
    hit = c.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(c, pattern, 1)).otherwise("UNKNOWN").alias("method"), F.when(hit, F.regexp_extract(c, pattern, 2)).otherwise(c).alias("path"))


def strip_quotes(c: str | Column) -> Column:
    """Without single and double quotes at both ends."""
    return F.regexp_replace(_c(c), "^['\"]+|['\"]+$", "")


def tokens(c: str | Column) -> Column:
    """Names inside ``${...}``."""
    return F.regexp_extract_all(_c(c), F.lit(r"\$\{([^}]+)\}"), F.lit(1))


def has_token(c: str | Column) -> Column:
    return F.contains(_c(c), F.lit("${"))


def substitute_from_map(c: str | Column, values: Column) -> Column:
    """Known tokens replaced by ``values`` (a map column); unknown ones and ``${}`` stay."""
    c = _c(c)
    keys = F.array_distinct(tokens(c))
    return F.aggregate(keys, c, lambda text, k: F.replace(text, F.concat(F.lit("${"), k, F.lit("}")), F.coalesce(values[k], F.concat(F.lit("${"), k, F.lit("}")))))


def arn_name(c: str | Column) -> Column:
    """Last part of an ARN of six parts or more, else the text."""
    c = _c(c)
    last = F.element_at(F.split(c, ":"), -1)
    return F.when((F.size(F.split(c, ":")) >= 6) & (last != ""), last).otherwise(c)


def is_canonical(c: str | Column, types: Sequence[str] = vocab.TYPES) -> Column:
    c = _c(c)
    return (F.instr(c, ":") > 0) & type_of(c).isin(*types) & (name_of(c) != "")


def canonical_id(kind: str | Column, name: str | Column, types: Sequence[str] = vocab.TYPES) -> Column:
    """Unknown types become ``Symbol``."""
    kind = _c(kind)
    return F.concat(F.when(kind.isin(*types), kind).otherwise("Symbol"), F.lit(":"), _c(name))


def edge_id(source: str | Column, label: str | Column, target: str | Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", _c(source), _c(label), _c(target)), 256), F.lit(16))


def text_hash(c: str | Column) -> Column:
    return F.left(F.sha2(F.trim(_c(c)), 256), F.lit(12))


def fingerprint(values: Column, salt: str) -> Column:
    """Aggregate: of a set of texts, whatever their order."""
    return F.left(F.sha2(F.concat(F.lit(salt), F.array_join(F.sort_array(F.collect_list(values)), "")), 256), F.lit(32))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normalize(c: str | Column) -> Column:
    """Lower case, trimmed; each run of white space, ``_`` and ``-`` is a blank.  A pattern is matched only where blanks follow each other."""
    blanks = F.translate(F.trim(F.lower(_c(c))), "_-\t\n\x0b\f\r", " " * 7)
    return _once(blanks, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " +", " ")).otherwise(t))


def detect(c: str | Column, phrases: Sequence[tuple[str, Sequence[str]]] = vocab.ACTION_PHRASES) -> Column:
    """Sorted labels with any phrase in the normalised text."""
    hits = lambda text: F.array(*[F.when(_any(text, words), F.lit(label)) for label, words in phrases])
    return F.sort_array(F.array_compact(_once(normalize(c), hits)))


def _any(text: Column, words: Sequence[str]) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def _hints(text: Column, words: Sequence[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def intent(c: str | Column, positive: Sequence[str] = vocab.POSITIVE, negative: Sequence[str] = vocab.NEGATIVE) -> Column:
    """The kind with strictly more distinct hints; neutral on a tie."""
    lead = _once(normalize(c), lambda text: _hints(text, positive) - _hints(text, negative))
    return _once(lead, lambda n: F.when(n < 0, "negative").when(n > 0, "positive").otherwise("neutral"))


def stage(columns: Sequence[str | Column], phrases: Sequence[tuple[str, Sequence[str]]] = vocab.STAGE_PHRASES) -> Column:
    """First stage by priority in the first column that has any, else ``general``."""

    def first(text: Column) -> Column:
        hit = F.lit(None).cast("string")
        for label, words in reversed(phrases):
            hit = F.when(_any(text, words), F.lit(label)).otherwise(hit)
        return hit

    return F.coalesce(*[_once(normalize(c), first) for c in columns], F.lit("general"))


def outcomes(keyword: str | Column, text: str | Column) -> Column:
    """Outcome labels of one step; empty unless it is a Then, And or But."""
    none = F.array().cast("array<string>")
    expected = lambda norm: F.contains(norm, F.lit("should")) | F.contains(norm, F.lit("must"))
    extra = lambda norm: F.array_compact(F.array(F.when(F.contains(norm, F.lit("not")) & F.contains(norm, F.lit("continue")), "expect_stop"), F.when(F.contains(norm, F.lit("notified")) | F.contains(norm, F.lit("notify")), "expect_notify")))
    said = _once(normalize(text), lambda norm: F.struct(expected(norm).alias("expected"), extra(norm).alias("extra")))
    both = F.struct(detect(text).alias("actions"), said.alias("said"))
    every = _once(both, lambda x: F.concat(x["actions"], F.when(x["said"]["expected"], F.transform(x["actions"], lambda a: F.concat(F.lit("expect_"), a))).otherwise(none), x["said"]["extra"]))
    return F.when(_c(keyword).isin("Then", "And", "But"), F.sort_array(F.array_distinct(every))).otherwise(none)


def overlap(a: str | Column, b: str | Column) -> Column:
    """Overlap coefficient of the words longer than two letters; 0 if either has none."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_c(c)), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 2))
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays: 1 if both are empty, 0 if one is."""
    a, b = _c(a), _c(b)
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(either > 0, either))


def section_key(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.lower(_c(c))), r"^[0-9.)\-: ]+", ""))


def section_tier(c: str | Column, tiers: Sequence[tuple[str, str]] = vocab.TIERS) -> Column:
    """primary, secondary or metadata; unknown sections are secondary."""
    key, out = section_key(c), F.lit("secondary")
    for name, tier in tiers:
        out = F.when(key == name, tier).otherwise(out)
    return out


def handler_to_function(c: str | Column) -> Column:
    """``pkg/mod.py.fn`` -> ``pkg.mod``: the module before the last dot, in dots, without ``.py``; NULL without a dot."""
    module = F.when(F.contains(_c(c), F.lit(".")), F.regexp_replace(_c(c), r"\.[^.]*$", ""))
    return F.regexp_replace(F.regexp_replace(module, r"[/\\]", "."), r"\.py$", "")


def app_id(meta: str | Column, path: str | Column, suffixes: Sequence[str] = ("_quads", "-quads", ".quads")) -> Column:
    """From the file's metadata, else from its name without a known suffix."""
    stem = F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"\.ya?ml$", "")
    for s in suffixes:
        stem = F.when(F.endswith(stem, F.lit(s)), F.regexp_replace(stem, s.replace(".", r"\.") + "$", "")).otherwise(stem)
    return F.coalesce(F.nullif(F.trim(_c(meta)), F.lit("")), stem)


def slug(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), r"[^\w]+", "-")


def item_id(unit: str | Column, section: str | Column, suffix: str | Column) -> Column:
    return F.left(F.concat_ws("::", _c(unit), slug(section), _c(suffix)), F.lit(80))


def json_list(c: str | Column) -> Column:
    """JSON list of strings; NULL -> empty, bad JSON -> [raw]."""
    c = _c(c)
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(c, "array<string>"), F.array(c)))


def json_map(c: str | Column) -> Column:
    """JSON object of strings; NULL and bad JSON -> empty."""
    return F.coalesce(F.from_json(_c(c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def provenance_note(backed: str | Column, sections: str | Column) -> Column:
    """Which oracle holds, and the sections that a person confirmed."""
    human = F.sort_array(F.map_keys(F.map_filter(_c(sections), lambda _, v: v == "human")))
    base = F.when(_c(backed), "requirement-backed: the document is the oracle").otherwise("code-derived: the code is the oracle")
    return F.when(F.size(human) > 0, F.concat(base, F.lit("; confirmed: "), F.array_join(human, ", "))).otherwise(base)


def grounding_descriptor(facts: str | Column, has_source: str | Column, unresolved: str | Column) -> Column:
    return F.concat(_c(facts).cast("string"), F.lit(" facts; source "), F.when(_c(has_source), "yes").otherwise("no"), F.lit("; "), _c(unresolved).cast("string"), F.lit(" of "), _c(facts).cast("string"), F.lit(" unresolved"))


def backbone(c: str | Column) -> Column:
    """Text after ``name=`` up to the next colon, trimmed; NULL where there is none."""
    return F.nullif(F.trim(F.regexp_extract(_c(c), "name=([^:]*)", 1)), F.lit(""))


def bucket_of(c: str | Column) -> Column:
    """Bucket of ``S3Object:bucket/key``; NULL for other ids."""
    c = _c(c)
    return F.when(F.startswith(c, F.lit("S3Object:")), F.substring_index(F.substr(c, F.lit(10)), "/", 1))


def band(c: str | Column) -> Column:
    return F.when(_c(c) >= 75, "Strong").when(_c(c) >= 50, "Partial").otherwise("Low")


def note_text(text: str | Column, subject: str | Column, predicate: str | Column, obj: str | Column) -> Column:
    return F.coalesce(F.nullif(F.trim(_c(text)), F.lit("")), F.nullif(F.trim(F.concat_ws(" ", _c(subject), _c(predicate), _c(obj))), F.lit("")))
