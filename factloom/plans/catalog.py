"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_declared, q_enrich, q_graph, q_lookup, q_match, q_scalars, q_sources, q_text  # noqa: F401  they register their queries
from .registry import QUERIES, SQL  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys, unwired chains and behaviours of the flow graph."""
    return QUERIES["h08_journeys"](spark, sf_dir)
