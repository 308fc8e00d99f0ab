"""What retrieval has left behind: documents, chunks and evidence of a product, and how they are shown.

A product's trace is a struct rag(queries, sources, documents(url, status), chunks_indexed, evidence(url, page, text, score)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import words

EVIDENCE = "struct<url:string,page:string,text:string,score:double>"
FIRST_QUERIES, PROMPT_QUERIES = 4, 5


def labelled(attributes: Column) -> Column:
    """Attributes that have a label."""
    return F.filter(attributes, lambda a: a["label"].isNotNull() & (a["label"] != ""))


def first_queries(queries: Column, n: int = FIRST_QUERIES) -> Column:
    return F.slice(queries, 1, n)


def evidence_for(attributes: Column, evidence: Column, label: Column) -> Column:
    """The evidence behind the first attribute with this label: of its source and page, or else of its source; null if there is none."""
    attribute = F.get(F.filter(attributes, lambda a: a["label"] == label), F.lit(0))
    source, page = attribute["source"], F.coalesce(attribute["source_page"].cast("string"), F.lit(""))
    there = F.filter(evidence, lambda e: (e["url"] == source) & (source != ""))
    return F.coalesce(F.get(F.filter(there, lambda e: e["page"] == page), F.lit(0)), F.get(there, F.lit(0)))


def distinct_chunks(chunks: DataFrame, order: str) -> DataFrame:
    """chunks(url, page, text, ...): of those equal in all three, the first by order; nulls are equal."""
    first = F.min_by(F.struct(*chunks.columns), order)
    return chunks.groupBy("url", "page", "text").agg(first.alias("r")).select("r.*")


def statistics(products: DataFrame) -> DataFrame:
    """One row of totals; what was not fetched has failed. Products without a trace count by their attributes only."""
    rag, own = F.col("rag"), labelled(F.coalesce("attributes", F.array().cast("array<struct<label:string,source:string>>")) if "attributes" not in products.columns else F.col("attributes"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) * c.isNotNull().cast("int")
    documents = rag["documents"]
    fetched = F.filter(documents, lambda d: F.coalesce(d["status"] == "fetched", F.lit(False)))
    return products.agg(
        total(size(rag["queries"]), "queries"),
        total(size(rag["sources"]), "sources"),
        total(size(fetched), "fetched"),
        total(size(documents) - size(fetched), "failed"),
        total(F.coalesce(rag["chunks_indexed"], F.lit(0)), "chunks"),
        total(size(rag["evidence"]), "evidence"),
        total(size(F.filter(own, lambda a: F.coalesce(a["source"] != "", F.lit(False)))), "grounded_attributes"),
        total(size(own), "attributes"),
        F.greatest(F.lit(1.0), F.coalesce(F.max(F.array_max(F.transform(rag["evidence"], lambda e: F.coalesce(e["score"], F.lit(0.0))))), F.lit(1.0))).alias("best_score"),
    )


def highlight_words(queries: Column, *own: Column) -> Column:
    """What to mark in a text: the product's own names and all words of its queries, each once."""
    asked = F.flatten(F.transform(F.coalesce(queries, F.array().cast("array<string>")), words))
    return F.array_distinct(F.array_compact(F.concat(F.array(*own), asked)))


# -- Labels ----------------------------------------------------------------------------------------------------------
def confidence_label(status: Column) -> Column:
    return F.coalesce(status, F.lit("n/a"))


def verdict_label(decision: Column) -> Column:
    return F.when(decision == "accept", "approved").when(decision == "reject", "rejected").otherwise("")


def verdict_text(decision: Column, at: Column) -> Column:
    """A sentence about a decision and its day; empty without one. at: ISO text."""
    day = F.coalesce(F.concat(F.lit(" on "), F.left(F.nullif(at, F.lit("")), F.lit(10))), F.lit(""))
    rejected = F.concat(F.lit("Rejected by human review"), day, F.lit(" — excluded from the catalogue and CSV exports."))
    accepted = F.concat(F.lit("Approved by human review"), day, F.lit(" — marked as commerce-ready."))
    edited = F.concat(F.lit("Edited"), day, F.lit(" — corrections saved, still awaiting a final Accept/Reject decision."))
    return F.when(decision == "reject", rejected).when(decision == "accept", accepted).when(F.coalesce(decision, F.lit("")) != "", edited).otherwise("")


def document_label(status: Column) -> Column:
    """Anything unknown has failed."""
    return F.when(status == "fetched", "fetched").when(status == "pdf_skipped", "pdf skipped").otherwise("failed")


def iso_time(at: Column) -> Column:
    """UTC as text, to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
