"""K3: incremental onboarding: each new fact file replaces its application's slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.readers import fact_records, facts_of_records, plain_path, quarantine
from ..sources.sinks import replace_app_slice
from ..sources.staged import sized


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str):
    """A query that takes every file there is and stops; run it again for new ones.  Bad files are kept as rows under ``target/rejected``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{yaml,yml}").load(source)

    def put(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # names, as the stream's own log has them
        if not paths:
            return
        good, bad = quarantine(fact_records(spark, [plain_path(p) for p in paths]))  # parsed once
        apps = sized(good.filter("kind = 'file'").select("file", S.app_id("a", "file").alias("app_id")), "applications")
        replace_app_slice(facts_of_records(good).join(apps, "file"), f"{target}/facts")
        bad.select("file", "kind", "at", "error", F.col("extra").alias("raw")).write.mode("append").parquet(f"{target}/rejected")

    return files.select("path").writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
