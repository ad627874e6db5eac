"""Names with ``${TOKEN}``: bindings by precedence, substitution, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .graph import latest


def bind(bindings: DataFrame) -> DataFrame:
    """(token, value) of the first layer that has the token."""
    return latest(bindings, ["token"], ["layer", "value"]).select("token", "value")


def substitute(df: DataFrame, col: str, bindings: DataFrame, key: str = "ord") -> DataFrame:
    """``df`` with ``text`` and ``fully_resolved``; unknown tokens and ``${}`` stay.

    The text is cut at its tokens, pieces are joined with the bindings by token and put
    together in order, so bindings of any number need no broadcast.
    """
    pieces = F.regexp_extract_all(F.col(col), F.lit(r"(\$\{[^}]+\}|[^$]+|\$)"), F.lit(1))
    cut = df.select(key, F.posexplode_outer(pieces).alias("at", "piece"))
    cut = cut.withColumn("token", F.when(F.col("piece").rlike(r"^\$\{[^}]+\}$"), F.regexp_extract("piece", r"^\$\{([^}]+)\}$", 1)))
    known = cut.filter("token IS NOT NULL").join(bind(bindings).hint("merge"), "token", "left").select(key, "at", F.coalesce("value", "piece").alias("piece"))
    put = known.unionByName(cut.filter("token IS NULL").select(key, "at", "piece"))  # plain pieces meet nothing
    whole = put.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return df.join(whole.hint("merge"), key).withColumn("fully_resolved", ~S.has_token("text"))


def apply_resolution(df: DataFrame) -> DataFrame:
    """A substituted fact is resolved with confidence 1 if no ``${`` is left and it isn't symbolic."""
    ok = F.col("fully_resolved") & ~F.coalesce("symbolic", F.lit(False))
    return df.withColumns({"resolved": F.when(ok, True).otherwise(F.col("resolved")), "confidence": F.when(ok, 1.0).otherwise(F.col("confidence"))})


def rename(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping(old, new)`` applied to subject and object."""
    out = facts
    for c in ("subject", "object"):
        m = mapping.select(F.col("old").alias(f"_{c}"), F.col("new").alias(f"_new_{c}"))
        out = out.join(m, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_{c}", f"_new_{c}")
    return out


def stale_renames(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    names = facts.select(F.col("subject").alias("old")).union(facts.select("object")).distinct()
    return mapping.join(names, "old", "left_anti")


def token_usages(facts: DataFrame, answered: DataFrame, n: int = 3) -> DataFrame:
    """Unanswered tokens with their number of uses and the first ``n`` of them."""
    used = facts.select("ord", "subject", "object", F.explode(F.array_distinct(S.tokens("object"))).alias("token")).join(answered.select("token").hint("merge"), "token", "left_anti")
    w = Window.partitionBy("token").orderBy("ord")
    some = used.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).groupBy("token").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "subject"))), lambda x: x["subject"]).alias("sample"))
    return used.groupBy("token").agg(F.count("*").alias("uses")).join(some.hint("merge"), "token")


def stale_answers(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Answered tokens that no fact holds any more."""
    return answers.select("token").distinct().join(facts.select(F.explode(S.tokens("object")).alias("token")).distinct().hint("merge"), "token", "left_anti")


def contradictions(answers: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tokens both answered and decided."""
    return answers.select("token").intersect(decisions.select("token"))
