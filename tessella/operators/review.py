"""Human review: decisions, queues, search and edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import let, strip

DECISIONS = ["accept", "reject", "edit"]
EDITABLE = ["attributes", "descriptions"]


def current(events: DataFrame) -> DataFrame:
    """(key, decision, at): the last of each key's valid events(key, decision, at, seq); seq settles equal times."""
    last = F.max_by(F.struct("decision", "at"), F.struct("at", "seq"))
    return events.where(F.col("decision").isin(DECISIONS) & F.col("key").isNotNull()).groupBy("key").agg(last.alias("r")).select("key", "r.decision", "r.at")


def overlay(products: DataFrame, stored: DataFrame, local: DataFrame) -> DataFrame:
    """products with decision and at: a local review wins over a stored one."""
    pick = lambda df, n: df.select("key", F.struct("decision", "at").alias(n))
    both = products.join(pick(stored, "_s"), "key", "left").join(pick(local, "_l"), "key", "left").withColumn("_r", F.coalesce("_l", "_s"))
    return both.select(*products.columns, F.col("_r.decision").alias("decision"), F.col("_r.at").alias("at"))


def upsert(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """products with the reviews' decisions; an edit replaces the editable columns that it brings. Unknown keys change nothing."""
    r = reviews.select("key", F.struct(*(c for c in reviews.columns if c != "key")).alias("_r"))
    joined = products.join(r, "key", "left")
    brought = [c for c in EDITABLE if c in reviews.columns and c in products.columns]
    new = {c: F.when(F.col("_r.decision") == "edit", F.coalesce(F.col(f"_r.{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c in brought}
    rest = [new.get(c, F.col(c)) for c in products.columns if c not in ("decision", "at")]
    old = lambda c: F.coalesce(F.col(f"_r.{c}"), F.col(c)) if c in products.columns else F.col(f"_r.{c}")
    return joined.select(*rest, old("decision").alias("decision"), old("at").alias("at"))


def problem(decision: Column, key: Column, at: Column) -> Column:
    """Why an event can't count, whatever its product; null if it can."""
    return F.when(F.coalesce(strip(key), F.lit("")) == "", "no key").when(~F.coalesce(decision.isin(DECISIONS), F.lit(False)), "bad decision").when(at.isNull(), "no time")


def replay(products: DataFrame, events: DataFrame) -> DataFrame:
    """products(key, ...) with decision and at after all events(key, decision, at, seq, and any of EDITABLE), whatever their order.

    A key's last event by (at, seq) decides. Each editable column is what the last edit that brings it says, so an edit
    merges only its own columns. Events that dead_letters() lists change nothing."""
    when = F.struct("at", "seq")
    brought = [c for c in EDITABLE if c in events.columns and c in products.columns]
    edits = [F.max_by(c, F.when((F.col("decision") == "edit") & F.col(c).isNotNull(), when)).alias(f"_{c}") for c in brought]
    last = events.where(problem(F.col("decision"), F.col("key"), F.col("at")).isNull()).groupBy("key").agg(F.max_by(F.struct("decision", "at"), when).alias("_last"), *edits)
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in brought else F.col(c) for c in products.columns if c not in ("decision", "at")]
    return products.join(last, "key", "left").select(*kept, F.col("_last.decision").alias("decision"), F.col("_last.at").alias("at"))


def dead_letters(products: DataFrame, events: DataFrame) -> DataFrame:
    """events that change nothing, with error: no key, a bad decision, no time, or no product of this key."""
    marked = events.join(products.select("key").distinct().withColumn("_known", F.lit(True)), "key", "left")
    error = F.coalesce(problem(F.col("decision"), F.col("key"), F.col("at")), F.when(F.col("_known").isNull(), "unknown key"))
    return marked.select(*events.columns, error.alias("error")).where("error IS NOT NULL")


def flagged(needs_review: Column, attributes: Column) -> Column:
    return F.coalesce(needs_review, F.lit(False)) | F.exists(attributes, lambda a: F.coalesce(a["needs_review"], F.lit(False)))


def resolved(decision: Column) -> Column:
    return F.coalesce(decision.isin("accept", "reject"), F.lit(False))


def active(products: DataFrame) -> DataFrame:
    return products.where(F.coalesce(F.col("decision") != "reject", F.lit(True)))


def search(products: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows where any column holds the query, without regard to case; a blank query keeps all."""
    q = query.strip().lower()
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False)) for c in columns))
    return products.where(hit) if q else products


def queue(products: DataFrame) -> DataFrame:
    """(key, status, reasons): flagged rows, open or resolved, with the first two reasons."""
    # A filter over one-row arrays: Spark would push a plain one down and work the scores out twice.
    state = F.when(resolved(F.col("decision")), "resolved").otherwise("open")
    row = F.struct(flagged(F.col("confidence.needs_review"), F.col("attributes")).alias("flagged"), F.col("key"), state.alias("state"), F.array_join(F.slice("confidence.reasons", 1, 2), "; ").alias("reasons"))
    return products.select(F.inline(F.filter(F.array(row), lambda r: r["flagged"]))).drop("flagged")


def progress(products: DataFrame) -> DataFrame:
    """One row: flagged, resolved among them and their share (null for none flagged), approved, rejected."""
    is_flagged = flagged(F.col("confidence.needs_review"), F.col("attributes"))
    out = products.agg(F.count_if(is_flagged).alias("flagged"), F.count_if(is_flagged & resolved(F.col("decision"))).alias("resolved"), F.count_if(F.col("decision") == "accept").alias("approved"), F.count_if(F.col("decision") == "reject").alias("rejected"))
    return out.withColumn("share", F.round(F.try_divide("resolved", "flagged"), 4))


def edit_diff(old: Column, new: Column) -> tuple[Column, Column]:
    """(attributes after the edit, number of changed ones): each of old takes value and unit of the first of new that has its
    label, in whatever order they come, and is marked edited where they differ. Labels that old lacks are not added."""
    changed = lambda a, b: ~a["value"].eqNullSafe(b["value"]) | ~a["uom"].eqNullSafe(b["uom"])

    def one(a: Column) -> Column:
        match = F.get(F.filter(new, lambda b: b["label"] == a["label"]), F.lit(0))
        return let(match, lambda b: F.struct(a["label"].alias("label"), F.when(b.isNotNull(), b["value"]).otherwise(a["value"]).alias("value"), F.when(b.isNotNull(), b["uom"]).otherwise(a["uom"]).alias("uom"), (b.isNotNull() & changed(a, b)).alias("edited")))

    merged = F.transform(old, one)
    return merged, F.size(F.filter(merged, lambda a: a["edited"]))
