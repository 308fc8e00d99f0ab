"""Streaming forms: uploads through the enrichment, and the current state of reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions import refdata
from tessella.operators.review import DECISIONS


def enrich_uploads(spark: SparkSession, folder: str, checkpoint: str, out: str, enrich: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """All catalogue files waiting in folder (canonical CSV), enriched in bounded batches; each batch is one atomic Parquet write,
    in a folder of its own, so that a batch run twice replaces itself."""
    schema = ", ".join(f"{c} string" for c in refdata.CATALOGUE_COLUMNS)
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", 100).csv(folder)

    def write(batch: DataFrame, number: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_decisions(events: DataFrame) -> DataFrame:
    """Streaming (key, decision, at): the last valid decision of a key so far, whenever it was made; for the
    output modes update and complete. State is one row a key, as the current state of reviews must keep."""
    valid = events.where(F.col("decision").isin(DECISIONS) & F.col("key").isNotNull() & F.col("at").isNotNull())
    return valid.groupBy("key").agg(F.max_by("decision", "at").alias("decision"), F.max("at").alias("at"))


def progress(query: StreamingQuery) -> dict:
    """What a poller is told."""
    last = query.lastProgress
    status = "error" if query.exception() else "running" if query.isActive else "done"
    return {"status": status, "rows": sum(p["numInputRows"] for p in query.recentProgress) if last else 0, "error": str(query.exception()) if query.exception() else None}
