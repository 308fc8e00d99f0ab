"""Runs of the enrichment that survive bad rows, and what is told about them."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import refdata
from tessella.functions.storing import stored
from tessella.operators import catalogue, delivery, metrics, positions
from tessella.operators.attributes import CANDIDATE
from tessella.plans import envelope
from tessella.plans.enrich import References, Services, stages
from tessella.sources import snapshots, tables


def enveloped(rows: DataFrame, refs: References, services: Services = Services(), extra: Sequence[envelope.Stage] = ()) -> DataFrame:
    """All rows through the stages, each in an envelope. extra: further stages, after those of the enrichment."""
    if envelope.INDEX not in rows.columns:
        rows = rows.withColumn(envelope.INDEX, F.monotonically_increasing_id())
    return envelope.through(rows, [*stages(refs, services), *extra])


def enrich_safely(rows: DataFrame, refs: References, services: Services = Services()) -> DataFrame:
    """Every row of rows: enriched where that is possible; else its raw columns, _error and _stage."""
    done = enveloped(rows, refs, services)
    failed = F.col(envelope.FAILED)
    raw = {c.lower(): F.when(failed.isNotNull(), F.col(f"{envelope.RAW}.{c}")).alias(c) for c in rows.columns if c not in ("reply", envelope.INDEX)}
    kept = [c for c in done.columns if c not in (envelope.RAW, envelope.FAILED) and (c != envelope.INDEX or c in rows.columns)]
    own = [F.coalesce(F.col(c), raw.pop(c.lower())).alias(c) if c.lower() in raw else F.col(c) for c in kept]
    return done.select(*own, *raw.values(), failed["reason"].alias("_error"), failed["stage"].alias("_stage"))


def scale_report(scored: DataFrame) -> DataFrame:
    """One row about a bulk run: rows, success and review rates, failures, products whose values all lack a source, mean confidence."""
    valued = F.filter("attributes", lambda a: F.coalesce(a["value"] != "", F.lit(False)))
    loose = (F.size(valued) > 0) & ~F.exists(valued, lambda a: F.coalesce(a["source"] != "", F.lit(False)))
    share = lambda n: F.coalesce(F.round(F.try_divide(n, F.count("*")), 4), F.lit(0.0))
    good = F.count_if("validation.valid")
    return scored.agg(
        F.count("*").alias("rows"), share(good).alias("success_rate"), share(F.count_if("confidence.needs_review")).alias("review_rate"), (F.count("*") - good).alias("failures"),
        F.count_if(loose).alias("missing_sources"), F.coalesce(F.round(F.avg("confidence.overall"), 4), F.lit(0.0)).alias("mean_confidence"),
    )


def sample_products(spark: SparkSession) -> DataFrame:
    """Two products stated in place, through the same texts, validation and scores as any other."""
    from tessella.operators import attributes, content, validate

    rows = [
        ("VLV-100", "Acme", "Acme", "Ball Valves", "Valves", "Plumbing", [("Material", "brass", None, "https://a.example/v", 1, 0.9), ("Size", "0.5", "inches", "https://a.example/v", 1, 0.9)]),
        ("DW-7", "Bolton", "Bolton", "Dishwashers", "Appliances", "Kitchen", [("Voltage Rating", "120", "volts", "https://b.example/d", 2, 0.95), ("Sound Level", "48", "dba", None, None, 0.4)]),
    ]
    df = spark.createDataFrame(rows, f"mpn string, manufacturer_name string, brand_name string, fine string, class_name string, dept string, candidates array<{CANDIDATE}>")
    none = F.lit(None).cast("string")
    df = df.select("*", none.alias("product_name"), none.alias("with_value"), F.array().cast("array<string>").alias("features"), F.lit(1.0).alias("manufacturer_confidence"), F.lit(0.95).alias("classification_confidence"))
    return validate.scored(content.with_content(df.withColumn("attributes", attributes.normalise_all(F.col("candidates"))).drop("candidates")))


def run(spark: SparkSession, source: str, taxonomy: str, out: str, limit: int | None = None, master: str | None = None, delivery_path: str | None = None, layout: str | None = None, snapshot: str | None = None) -> dict:
    """A catalogue file through the enrichment; returns the report and the seconds taken.

    out gets the products as JSON, out + '-errors' the rows that can't be enriched, with stage and reason, if there are any.
    delivery_path gets one CSV row for each input row, in their order; those of bad rows hold what came in. taxonomy: Parquet
    of (ordinal, dept, class_name, fine, keywords). master: a table of manufacturers and brands; without one, names pass
    through. layout: a CSV whose header is the delivery layout. limit: the first rows of the file. snapshot: a folder where products,
    errors, delivery and metrics become visible together, see sources.snapshots."""
    start = time.time()
    rows, headers = tables.read_catalogue(spark, source)
    rows = tables.first_rows(positions.row_index(rows.select(*refdata.CATALOGUE_COLUMNS)), envelope.INDEX, limit)
    catalogue.require_some_content(catalogue.cleaned(tables.require_rows(rows)))
    lists = [tables.read_master(tables.read_table(spark, master), kind) for kind in ("manufacturer", "brand")] if master else [None, None]
    done = stored(enveloped(rows.withColumn("row_id", F.col(envelope.INDEX).cast("string")), References(spark.read.parquet(taxonomy), *lists)))
    good, bad = envelope.products(done), envelope.quarantine(done)
    tables.write_products(good.drop(envelope.INDEX), out)
    errors = bad.count()
    if errors:
        tables.write_products(bad, f"{out.rstrip('/')}-errors")
    columns = tables.read_headers(spark, layout)
    every = [*columns, envelope.INDEX]
    delivered = delivery.delivery(good, every).unionByName(delivery.complete(bad.drop("stage", "reason"), every))
    delivered = delivered.orderBy(F.col(envelope.INDEX).cast("long")).drop(envelope.INDEX)
    if delivery_path:
        tables.write_delivery(delivered, delivery_path, columns)
    if snapshot:
        complete = {"no row id": F.col("row_id").isNotNull(), "no score": F.col("confidence.status").isNotNull()}
        parts = {"products": good.drop(envelope.INDEX), "errors": bad, "delivery": delivered, "metrics": metrics.batch_metrics(good)}
        snapshots.publish(spark, snapshot, parts, {"products": complete}, {"products": snapshots.json, "delivery": snapshots.csv})
    report = metrics.batch_metrics(spark.read.schema(good.schema).json(out)).first().asDict()
    return report | {"errors": errors, "headers": headers.mapped, "seconds": round(time.time() - start, 1)}
