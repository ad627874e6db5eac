"""Suite-to-suite matching: profile classes, blocked pair scores, greedy matching by suite."""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import scalars as S
from ..sources import versions
from ..sources.staged import shared_dir, stage

KEY = ("stage", "intent", "actions", "outcomes")


def _stage_score(a: Column, b: Column) -> Column:
    near = a == "general"
    for x, y in vocab.COMPATIBLE:
        near = near | ((a == x) & (b == y))
    return F.when(a == b, 1.0).when(near, 0.7).otherwise(0.0)


def score(strict: bool = False) -> Column:
    """D15 on columns stage, intent, actions, outcomes and stage2, ...; terms are added in a fixed order."""
    st = _stage_score(F.col("stage"), F.col("stage2"))
    act, out = S.jaccard("actions", "actions2"), S.jaccard("outcomes", "outcomes2")
    base = F.lit(0.30) * st + F.lit(0.45) * act + F.lit(0.25) * out
    if strict:
        no_common = (F.size(F.array_intersect("actions", "actions2")) == 0) & ((F.size("actions") > 0) | (F.size("actions2") > 0))
        return F.when((F.col("intent") != F.col("intent2")) | (F.col("stage") != F.col("stage2")) | no_common, 0.0).otherwise(base)
    both = (F.col("intent") != "neutral") & (F.col("intent2") != "neutral")
    return F.when((F.col("intent") != F.col("intent2")) & both, 0.0).when((F.col("intent") == F.col("intent2")) & both, F.least(F.lit(1.0), base + F.lit(0.05))).otherwise(base)


#: Parts into which the reference classes of a suite are dealt.
SALTS = 8
#: Intents that a pair with a score can have.
_MEETS = {"positive": ("positive", "neutral"), "negative": ("negative", "neutral"), "neutral": ("positive", "negative", "neutral")}


def pair_scores(ref: DataFrame, cand: DataFrame, strict: bool = False) -> DataFrame:
    """Scores of profile classes by application; a score depends on nothing else, so equal profiles are one row.

    Classes meet only where their intents can agree, in strict mode also only in the same
    stage; those of one large suite meet in ``SALTS`` parts.
    """
    r = ref.select("app_id", *KEY).distinct().withColumn("_salt", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).cast("int"))
    c = cand.select("app_id", *[F.col(k).alias(f"{k}2") for k in KEY]).distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = ["app_id", "intent2", "_salt"]
    if strict:
        r, c, on = r.withColumn("intent2", F.col("intent")).withColumn("_stage", F.col("stage")), c.withColumn("_stage", F.col("stage2")), [*on, "_stage"]
    else:
        met = F.array(F.col("intent"))
        for kind, others in _MEETS.items():
            met = F.when(F.col("intent") == kind, F.array(*[F.lit(o) for o in others])).otherwise(met)
        r = r.withColumn("intent2", F.explode(met))
    out = r.join(c.hint("merge"), on).withColumn("score", score(strict)).filter("score > 0")
    return out.select("app_id", *KEY, *[f"{k}2" for k in KEY], "score")


def _queues(members: pd.DataFrame) -> tuple[dict[int, list[np.ndarray]], np.ndarray]:
    """Ids of each class in order with the place of each id among all, and which of those are taken."""
    every, place = np.unique(members["id"].to_numpy(np.int64), return_inverse=True)
    cls = members["cls"].to_numpy(np.int64)
    order = np.lexsort((place, cls))
    names, starts = np.unique(cls[order], return_index=True)
    place = place[order]
    return {int(k): [every[own], own] for k, own in zip(names, np.split(place, starts[1:]))}, np.zeros(len(every), bool)


def _greedy(pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Best score first, then reference id, then candidate id.  A class gives its ids in order, so the state is one
    place a class; each id is passed once."""
    (refs, used_r), (cands, used_c) = (_queues(members[members["side"] == side]) for side in (0, 1))
    at_r, at_c = dict.fromkeys(refs, 0), dict.fromkeys(cands, 0)

    def head(queues: dict, at: dict, used: np.ndarray, k: int) -> int | None:
        ids, place = queues[k]
        while at[k] < len(ids) and used[place[at[k]]]:
            at[k] += 1
        return int(ids[at[k]]) if at[k] < len(ids) else None

    out = []
    for value, level in sorted(pairs.groupby("score"), key=lambda x: -x[0]):
        near = {int(k): own["cls2"].tolist() for k, own in level.groupby("cls")}
        heap = [(i, k) for k in near if (i := head(refs, at_r, used_r, k)) is not None]
        heapq.heapify(heap)
        while heap:
            i, k = heapq.heappop(heap)
            if head(refs, at_r, used_r, k) == i:  # else an equal id of another class went first
                best = min(((j, c) for c in near[k] if (j := head(cands, at_c, used_c, c)) is not None), default=None)
                if best is None:
                    continue  # nothing is left for this class at this score
                used_r[refs[k][1][at_r[k]]] = used_c[cands[best[1]][1][at_c[best[1]]]] = True
                out.append((i, best[0], value))
            if (i := head(refs, at_r, used_r, k)) is not None:
                heapq.heappush(heap, (i, k))
    app = pairs["app_id"].iloc[0] if len(pairs) else None
    return pd.DataFrame([(app, *x) for x in out], columns=["app_id", "ref_id", "cand_id", "score"])


def greedy_match(ref: DataFrame, cand: DataFrame, threshold: float = 0.45, strict: bool = False) -> DataFrame:
    """(app_id, ref_id, cand_id, score): pairs by score descending, then ids, each side once; one task a suite,
    which holds each id once and the scores of class pairs."""
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    w = Window.partitionBy("app_id").orderBy(*KEY)
    number = lambda df: df.select("app_id", *KEY).distinct().withColumn("cls", F.row_number().over(w))
    r, c = number(ref), number(cand)
    c2 = c.select("app_id", *[F.col(k).alias(f"{k}2") for k in KEY], F.col("cls").alias("cls2"))
    pairs = r.join(c2, "app_id").withColumn("score", score(strict)).filter(F.col("score") >= threshold).select(*[F.col(x).alias(x) for x in ("app_id", "cls", "cls2", "score")])
    ids = lambda df, classes, side: df.join(classes, ["app_id", *KEY]).select("app_id", F.lit(side).alias("side"), "cls", "id")
    members = ids(ref, r, 0).unionByName(ids(cand, c, 1)).select(*[F.col(x).alias(x) for x in ("app_id", "side", "cls", "id")])  # the aliases tell both sides of the cogroup apart
    return pairs.groupBy("app_id").cogroup(members.groupBy("app_id")).applyInPandas(_greedy, "app_id string, ref_id long, cand_id long, score double")


def unmatched(ref: DataFrame, cand: DataFrame, matches: DataFrame) -> DataFrame:
    """Reference rows without a match, with their best score over all pairs (0 if none)."""
    best = pair_scores(ref, cand).groupBy("app_id", *KEY).agg(F.max("score").alias("best"))
    left = ref.join(matches.select(F.col("ref_id").alias("id")).hint("merge"), "id", "left_anti")
    return left.join(best, ["app_id", *KEY], "left").select("app_id", "id", F.coalesce("best", F.lit(0.0)).alias("best"))


def match_requirements(items: DataFrame, generated: DataFrame, threshold: float = 0.45) -> DataFrame:
    """(app_id, item, generated, score, unit, negative): criteria matched as in D16, with their own attributes."""
    found = greedy_match(items, generated, threshold).select(F.col("ref_id").alias("item"), F.col("cand_id").alias("generated"), "score").hint("merge")
    own = items.select("app_id", F.col("id").alias("item"), "unit", (F.col("intent") == "negative").alias("negative"))
    return own.join(found, "item")


def triangulate(manual: DataFrame, requirement: DataFrame) -> DataFrame:
    """Generated scenarios matched by both sides; of equal names the last row wins."""
    last = lambda df, c: df.groupBy("generated").agg(F.max_by(c, "ord").alias(c))
    return last(manual, "manual").join(last(requirement, "requirement"), "generated")


#: Length of the keys on which names and units meet.
GRAM = 3


def near_unit(units: DataFrame, profiles: DataFrame) -> DataFrame:
    """Units whose id occurs, in any case, in a file or scenario name.

    A unit meets the names that hold the one of its grams (``GRAM`` letters, or all of a
    shorter one) that the fewest names have, and is then looked for in full; so units with a
    common beginning don't meet all names that share it.
    """
    grams = lambda c, n: F.when(n == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda at: F.substring(c, at, n)))
    low = F.lower("unit")
    u = units.select("unit", low.alias("low")).distinct().withColumn("n", F.least(F.lit(GRAM), F.length("low")))
    asked = stage(u.select("unit", "low", F.explode(F.array_distinct(grams(F.col("low"), F.col("n")))).alias("gram")), "unit-grams")
    names = stage(profiles.select(F.monotonically_increasing_id().alias("row"), "name", F.lower("feature_file").alias("file"), F.lower("name").alias("low_name")), "unit-names")
    both = F.array_compact(F.array("file", "low_name"))
    sizes = F.sequence(F.lit(0), F.lit(GRAM))
    held = F.flatten(F.transform(both, lambda t: F.flatten(F.transform(sizes, lambda n: F.filter(grams(t, n), lambda g: F.length(g) == n)))))
    keyed = names.select("row", F.explode(F.array_distinct(held)).alias("gram")).join(asked.select("gram").distinct().hint("merge"), "gram", "left_semi")
    keyed = stage(keyed, "unit-keys")
    counts = keyed.groupBy("gram").agg(F.count("*").alias("held"))
    rare = asked.join(counts.hint("merge"), "gram", "left").groupBy("unit", "low").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("r")).filter("r.held > 0")
    pairs = rare.select("unit", "low", F.col("r.gram").alias("gram")).join(keyed.hint("merge"), "gram").select("unit", "low", "row")
    hit = F.coalesce(F.contains("file", "low"), F.lit(False)) | F.coalesce(F.contains("low_name", "low"), F.lit(False))
    found = pairs.join(names.hint("merge"), "row").filter(hit).select("unit", "name")
    return units.select("unit").join(found.hint("merge"), "unit")


def apply_credits(credits: DataFrame, missing: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Credits whose manual is missing and whose generated exists; missing rows they don't cover."""
    kept = credits.join(missing.select("manual"), "manual", "left_semi").join(generated.select("generated"), "generated", "left_semi")
    return kept, missing.join(kept.select("manual"), "manual", "left_anti")


NOTES = "note string"
_CREDITS, _REDUNDANT = "manual {0}, generated {1}, covers boolean", "id {1}"


def coverage_assist(manual: DataFrame, generated: DataFrame, matches: DataFrame, ask, cache: str | None = None, salt: str = "1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """L2: (manual) credited and (id) redundant rows, from what ``ask`` says about the unmatched manual and the generated rows, and notes.

    ``ask(missing, generated)`` returns credits(manual, generated, covers) and redundant(id);
    what names no such row is left out.  With the folder ``cache`` an answer is kept under
    the fingerprint of both tables and the salt, and the same question isn't asked again.  A
    failing ``ask`` credits nothing and leaves a note.
    """
    spark = manual.sparkSession
    missing = stage(manual.join(matches.select(F.col("ref_id").alias("id")).hint("merge"), "id", "left_anti"), "assist-missing")
    types = [dict(df.select("id").dtypes)["id"] for df in (missing, generated)]
    tables = {"credits": _CREDITS.format(*types), "redundant": _REDUNDANT.format(*types)}
    root = cache or f"{shared_dir(spark)}/assist-{uuid.uuid4().hex}"
    print_ = lambda df: "|".join(map(str, df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.pmod(F.xxhash64(F.lit(7), *df.columns), F.lit(1 << 31)))).first()))
    name = hashlib.sha256(f"{salt}#{print_(missing)}#{print_(generated)}".encode()).hexdigest()[:32]
    notes: list[tuple[str]] = []
    if name not in versions.current(spark, root):
        try:
            credits, redundant = ask(missing, generated)
            versions.publish(spark, root, name, {"credits": credits.select("manual", "generated", "covers"), "redundant": redundant.select("id").distinct()})
        except Exception as e:  # what an assistant can't answer stays open
            notes.append((f"coverage assist failed: {type(e).__name__}: {str(e).splitlines()[0][:200]}",))
    credits, redundant = (versions.read(spark, root, t, schema, [name]) for t, schema in tables.items())
    named = apply_credits(credits.filter("covers"), missing.select(F.col("id").alias("manual")), generated.select(F.col("id").alias("generated")))[0]
    return named.select("manual").distinct(), redundant.join(generated.select("id").hint("merge"), "id", "left_semi"), spark.createDataFrame(notes, NOTES)


def profile_scenarios(steps: DataFrame) -> DataFrame:
    """One profile a scenario from ``steps(feature_file, feature_name, name, pos, keyword, text)``."""
    key = ["feature_file", "feature_name", "name"]
    acting = F.when(F.col("keyword").isin("When", "Then", "And", "But"), S.detect("text")).otherwise(F.array().cast("array<string>"))
    g = steps.withColumns({"a": acting, "o": S.outcomes("keyword", "text")}).groupBy(*key).agg(
        F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("o")).alias("o"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("texts")
    )
    corpus = F.concat_ws(" ", *key, "texts")
    actions = F.sort_array(F.array_distinct(F.concat("a", S.detect("name"))))
    out = g.select(*key, S.stage(["feature_file", "feature_name", "name", corpus]).alias("stage"), S.intent(F.concat_ws(" ", "name", "texts")).alias("intent"), actions.alias("actions"), F.sort_array(F.array_distinct("o")).alias("outcomes"))
    return out.withColumn("signature", F.concat_ws("|", "stage", "intent", F.when(F.size("actions") > 0, F.array_join("actions", ",")).otherwise("none")))


def summarize_scenarios(steps: DataFrame) -> DataFrame:
    """(id, given, when_then, all_lines)."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "keyword", "text")))
    line = lambda x: F.concat_ws(" ", x["keyword"], x["text"])
    g = steps.groupBy("feature_file", "name").agg(rows.alias("r"))
    pick = lambda words: F.array_join(F.transform(F.filter("r", lambda x: x["keyword"].isin(*words)), line), "\n")
    return g.select(F.concat_ws("::", "feature_file", "name").alias("id"), pick(("Given",)).alias("given"), pick(("When", "Then")).alias("when_then"), F.array_join(F.transform("r", line), "\n").alias("all_lines"))


def label(df: DataFrame, fn, cache: DataFrame, salt: str = "1") -> DataFrame:
    """L1: (fingerprint, label): the cache, and ``fn`` (an iterator of pandas frames to frames) over what it lacks."""
    keyed = df.withColumn("fingerprint", F.sha2(F.concat(F.lit(salt), "text"), 256)).select("fingerprint", "text").dropDuplicates(["fingerprint"])
    new = keyed.join(cache.select("fingerprint"), "fingerprint", "left_anti").mapInPandas(fn, "fingerprint string, label string")
    return cache.select("fingerprint", "label").unionByName(new)


LABELS = "fingerprint string, label string"


def _guarded(fn):
    """``fn`` batch by batch; a batch that fails gives rows without a label and the error as a note."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                out = pd.concat([pd.DataFrame(columns=["fingerprint", "label"]), *fn(iter([pdf]))])[["fingerprint", "label"]].assign(note=None)
            except Exception as e:  # the others are labelled all the same
                out = pd.DataFrame({"fingerprint": pdf["fingerprint"], "label": None, "note": f"{type(e).__name__}: {e}"})
            yield out

    return run


def label_once(df: DataFrame, fn, root: str, salt: str = "1", name: str = "labels") -> DataFrame:
    """L1: (fingerprint, label, note) of the texts of ``df``, from the table of labels below ``root`` and ``fn`` over what it lacks.

    New labels are appended to the table, so nothing is asked twice, however many runs there
    are; texts of a batch that failed have a note, no label, and are asked again next time.
    """
    spark = df.sparkSession
    keyed = stage(df.select(F.sha2(F.concat(F.lit(salt), "text"), 256).alias("fingerprint"), "text").dropDuplicates(["fingerprint"]), "label-texts")
    known = versions.read(spark, root, "labels", LABELS, [name]).dropDuplicates(["fingerprint"])
    known = stage(keyed.select("fingerprint").join(known.hint("merge"), "fingerprint"), "label-known")
    new = keyed.join(known.select("fingerprint").hint("merge"), "fingerprint", "left_anti").mapInPandas(_guarded(fn), LABELS + ", note string")
    new = stage(new, "label-new")
    gained = new.filter("note IS NULL AND label IS NOT NULL").select("fingerprint", "label")
    if not gained.isEmpty():
        versions.append(spark, root, name, "labels", gained)
    return known.withColumn("note", F.lit(None).cast("string")).unionByName(new)


def compact_labels(spark: SparkSession, root: str, name: str = "labels") -> None:
    """L1: the table of labels anew, one row a fingerprint in few files; readers go on with the old one until it is complete."""
    rows = versions.read(spark, root, "labels", LABELS, [name])
    versions.publish(spark, root, name, {"labels": rows.dropDuplicates(["fingerprint"])})


def batch(df: DataFrame, max_n: int, max_chars: int, key: str = "doc_id", order: str = "pos", size: str = "size") -> DataFrame:
    """F8: batch numbers inside each key: a batch closes at ``max_n`` items or before ``max_chars`` is passed.

    A task reads its keys in order, row by row; no key is held as a whole.
    """

    def fold(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, chars, number = object(), 0, 0, 0
        for t in tables:
            out = []
            for k, s in zip(t[key].to_pylist(), t[size].to_pylist()):
                s = math.nan if s is None else s
                if k != last:
                    last, n, chars, number = k, 0, 0, 0
                if n and (n >= max_n or chars + s > max_chars):
                    number, n, chars = number + 1, 0, 0
                n, chars = n + 1, chars + s
                out.append(number)
            yield pa.record_batch([t[key], t[order], pa.array(out, pa.int32())], [key, order, "batch"])

    dealt = df.select(F.col(key).cast("long").alias(key), F.col(order).cast("int").alias(order), size).repartition(F.xxhash64(key))
    return dealt.sortWithinPartitions(key, F.asc_nulls_last(order)).mapInArrow(fold, f"{key} long, {order} int, batch int")


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """F7"""
    return df.orderBy(*order).limit(k)


def approved_examples(examples: DataFrame, unit: str, n: int = 2) -> DataFrame:
    """same unit first, then newest, then largest id, ``n`` by application."""
    w = Window.partitionBy("app_id").orderBy((F.col("unit") == unit).desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc())
    return examples.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


#: Queries and vectors of one task, and the vectors that meet its queries at a time.
QUERIES, VECTORS, SLICE = 4096, 32_768, 512


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay and are like nothing."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1.0, norm)


def _first(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best (query, vector, cosine) of each query."""
    query, vec, cosine = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((vec, -cosine, query))
    query, vec, cosine = query[order], vec[order], cosine[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], vec[kept], cosine[kept]


def _nearest(k: int):
    """The ``k`` nearest of a part of the vectors to each query of a block, by cosine to nine places, then id."""

    def matrix(table: pa.Table) -> np.ndarray:
        return unit_rows(table["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1))

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, best = queries["vec_id"].to_numpy(), []
        if queries.num_rows:
            q = matrix(queries)
            for at in range(0, vectors.num_rows, SLICE):
                part = vectors.slice(at, SLICE)
                own = part["vec_id"].to_numpy()
                s = matrix(part) @ q.T
                np.round(s, 9, out=s)
                s[own[:, None] == ids[None, :]] = -np.inf
                least = np.partition(s, len(s) - k, axis=0)[len(s) - k] if len(s) > k else np.full(len(ids), -np.inf)
                row, col = np.nonzero((s >= least) & (s > -np.inf))
                best = [_first([*best, (col, own[row], s[row, col])], k)]
        col, vec, cosine = best[0] if best else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(ids[col], pa.int64()), "vec_id": pa.array(vec, pa.int64()), "cosine": pa.array(cosine, pa.float64())})

    return run


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERIES, part: int = VECTORS) -> DataFrame:
    """(query_id, vec_id, cosine, rank) by cosine to nine places, then id.  ``queries`` is the stated query set.

    Blocks of some ``block`` queries meet parts of some ``part`` vectors, one pair a task;
    a task returns its ``k`` best of each query.  Vectors without length have cosine 0, null
    ones are left out; a query id that occurs twice counts once.
    """
    rows = lambda df, name: stage(df.filter("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")), name)
    v, q = rows(vectors, "vectors"), rows(queries.dropDuplicates(["vec_id"]), "vector-queries")
    parts, blocks = max(1, -(-v.count() // part)), max(1, -(-q.count() // block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("part", deal(parts)).withColumn("block", every(blocks))
    q = q.withColumn("block", deal(blocks)).withColumn("part", every(parts))
    found = q.groupBy("part", "block").cogroup(v.groupBy("part", "block")).applyInArrow(_nearest(k), "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
