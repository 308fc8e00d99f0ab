"""Further named queries: model choices, evidence and traces, labels, facts, reports, rows that can't be enriched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import attributes, choices, metrics, trace
from tessella.plans import queries as q
from tessella.plans import run, standin
from tessella.plans.queries import _ACC, _SCORED_SQL, _products, _read, _scored, query


# -- Choices and lookups ---------------------------------------------------------------------------------------------
_ANSWER = "CASE n_nationkey % 4 WHEN 0 THEN concat('  ', upper(n_name), ' ') WHEN 1 THEN lower(n_name) WHEN 2 THEN 'Atlantis' END"


@query(f"SELECT n_name AS id, CASE WHEN n_nationkey % 4 < 2 THEN n_name END AS name, CASE WHEN n_nationkey % 4 < 2 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN n_nationkey % 4 < 2 THEN 'llm' ELSE 'unresolved' END AS method FROM nation")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for the service answers with a nation in other letters, an invented one, or nothing."""
    nation = _read(spark, sf_dir, "nation")
    listed = nation.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("options"))
    asked = nation.join(listed, "n_regionkey").select(F.col("n_name").alias("id"), "options")
    return choices.chosen(asked, lambda df: df.join(nation, df["id"] == nation["n_name"]).select("id", F.expr(_ANSWER).alias("answer")))


_FIRST = "CASE p_partkey % 4 WHEN 0 THEN ' UNBRANDED ' WHEN 1 THEN p_brand WHEN 2 THEN replace(p_brand, 'rand#', 'ran') ELSE '#?' END"
_SECOND = "CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_brand, '#', ' ')) WHEN 2 THEN p_brand ELSE 'N/A' END"


@query(f"""WITH RECURSIVE {q._MASTER_SQL}, spelt AS (SELECT DISTINCT replace(p_brand, 'rand#', 'ran') AS raw FROM part), {q._fuzzy_sql("spelt", 0.72)}
SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN near.name WHEN 3 THEN NULL ELSE p_brand END AS name, CASE p_partkey % 4 WHEN 0 THEN 0.97::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN near.confidence ELSE 0.0::DOUBLE END AS confidence FROM part LEFT JOIN near ON raw = replace(p_brand, 'rand#', 'ran')""")
def best_brand_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first column that resolves: a placeholder gives way to the second column, a misspelt brand doesn't."""
    p = standin.part(spark, sf_dir)
    rows = p.select("p_partkey", F.expr(_FIRST).alias("first"), F.expr(_SECOND).alias("second"))
    out = choices.best_of(rows, ["first", "second"], standin.master(p))
    return out.select("p_partkey", "best_match.name", "best_match.confidence")


@query("SELECT p_partkey, CASE WHEN lower(trim(x)) NOT IN ('-- unbranded --', '-- no unilog brand --', '-- no dib brand --', '-- no e1 brand --', 'n/a', 'none', '', 'unbranded') THEN trim(x) END AS brand FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' UnBranded ' WHEN 1 THEN 'N/A' WHEN 2 THEN ' ' || p_brand ELSE 'None' END AS x FROM part)")
def brand_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN ' UnBranded ' WHEN 1 THEN 'N/A' WHEN 2 THEN concat(' ', p_brand) ELSE 'None' END")
    return standin.part(spark, sf_dir).select("p_partkey", choices.brand_or_null(raw).alias("brand"))


@query("SELECT p_brand AS name, 'C' || min(p_partkey) AS code, min(p_partkey) AS ordinal FROM part GROUP BY p_brand")
def master_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.part(spark, sf_dir).select(F.concat(F.lit(" "), "p_brand").alias("name"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_partkey").alias("ordinal"))
    return choices.distinct_names(rows.unionByName(rows.select(F.lit("  ").alias("name"), "code", "ordinal")))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Hardware>Tools>Anvils' WHEN 1 THEN 'Plumbing>Valves>Valves' ELSE 'Plumbing>Valves' END AS path, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 END AS ordinal FROM part")
def taxonomy_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = standin.part(spark, sf_dir).select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Hardware>Tools>Anvils' WHEN 1 THEN 'Plumbing>Valves>Valves' ELSE 'Plumbing>Valves' END").alias("path"))
    return choices.by_path(paths, standin.taxonomy(spark)).select("p_partkey", "path", "entry.ordinal")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY file_row_number) - 1 AS row_index FROM (SELECT n_nationkey, row_number() OVER () AS file_row_number FROM nation)")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices.row_index(_read(spark, sf_dir, "nation")).select("n_nationkey", "row_index")


@query("SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").withColumn("seq", F.struct("ts", "event_id"))
    return choices.point(rows, "user_id", 7, "seq").select("event_id", "event_type")


# -- Facts and evidence ----------------------------------------------------------------------------------------------
@query("SELECT p_partkey, 'size=' || CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE CAST(p_size AS VARCHAR) END || CASE WHEN p_partkey % 2 = 0 THEN '/tone=low' ELSE '' END AS facts, false AS empty FROM part")
def facts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(F.lit("row_id"), F.col("p_partkey").cast("string"), F.lit("size"), F.col("p_size").cast("string"), F.lit("color"), F.lit(None).cast("string"))
    extras = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("size"), F.lit("own"), F.lit("tone"), F.lit("low")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(attributes.all_facts(known, extras)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "/")
    return standin.part(spark, sf_dir).select("p_partkey", shown.alias("facts"), attributes.no_facts(known, extras).alias("empty"))


_TRACED = {
    "queries": "CASE WHEN p_partkey % 3 = 0 THEN array('ball valve', 'valve size') ELSE array('one  two three') END",
    "sources": "array('u1', 'u2')",
    "documents": "array(named_struct('url', 'u1', 'status', 'fetched'), named_struct('url', 'u2', 'status', CASE p_partkey % 4 WHEN 0 THEN 'fetched' WHEN 1 THEN 'pdf_skipped' WHEN 2 THEN 'timeout' END))",
    "chunks_indexed": "CAST(p_partkey % 5 AS INT)",
    "evidence": "array(named_struct('url', 'http://a.example/1', 'page', '9', 'text', 'other page', 'score', 2.5D), named_struct('url', 'http://a.example/1', 'page', '1', 'text', 'size page', 'score', CAST(p_partkey % 7 AS DOUBLE)), named_struct('url', 'http://a.example/2', 'page', '8', 'text', 'material', 'score', 1.0D))",
}


def _traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rag = F.struct(*(F.expr(e).alias(k) for k, e in _TRACED.items()))
    return _products(spark, sf_dir).withColumn("rag", F.when(F.col("p_partkey") % 6 > 0, rag))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'size page' WHEN p_partkey % 4 = 1 THEN 'material' END AS text FROM part")
def evidence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source and page, by source alone, and an attribute without a source."""
    label = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Size' WHEN 1 THEN 'Material' WHEN 2 THEN 'Voltage Rating' ELSE 'No Such' END")
    found = trace.evidence_for(F.col("attributes"), F.col("rag.evidence"), label)
    return _traced(spark, sf_dir).select("p_partkey", found["text"].alias("text"))


@query("SELECT CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END) FILTER (WHERE t) AS BIGINT) AS queries, CAST(2 * count(*) FILTER (WHERE t) AS BIGINT) AS sources, CAST(sum(CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END) FILTER (WHERE t) AS BIGINT) AS fetched, CAST(sum(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END) FILTER (WHERE t) AS BIGINT) AS failed, CAST(sum(p_partkey % 5) FILTER (WHERE t) AS BIGINT) AS chunks, CAST(3 * count(*) FILTER (WHERE t) AS BIGINT) AS evidence, CAST(7 * count(*) AS BIGINT) AS grounded_attributes, CAST(8 * count(*) AS BIGINT) AS \"attributes\", max(greatest(2.5, p_partkey % 7)) FILTER (WHERE t)::DOUBLE AS best_score FROM (SELECT *, p_partkey % 6 > 0 AS t FROM part)")
def retrieval_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.statistics(_traced(spark, sf_dir))


@query("SELECT doc_id, text[:3] AS start, min(rank) AS rank FROM (SELECT doc_id // 4 AS doc_id, coalesce(text, '') AS text, doc_id AS rank FROM documents) GROUP BY doc_id, text")
def chunk_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("url"), F.lit(0).alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("rank"))
    return trace.distinct_chunks(docs, "rank").select(F.col("url").alias("doc_id"), F.left("text", F.lit(3)).alias("start"), "rank")


@query("SELECT p_partkey, 'P' || p_partkey || '/Maker ' || (p_partkey % 76) || '/' || p_brand || '®' || CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN '/ball/valve/size' ELSE '/one/two/three' END AS words, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS asked FROM part")
def highlight_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = F.col("rag.queries")
    own = trace.highlight_words(queries, F.col("mpn"), F.col("manufacturer_name"), F.col("brand_name"))
    return _traced(spark, sf_dir).select("p_partkey", F.array_join(own, "/").alias("words"), F.when(F.col("rag").isNotNull(), F.size(trace.first_queries(queries))).alias("asked"))


@query("SELECT p_partkey, CAST(6 AS BIGINT) AS labelled FROM part")
def labelled_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.transform("attributes", lambda a, i: a.withField("label", F.when(i == 0, F.lit("")).when(i > 1, a["label"])))
    return _products(spark, sf_dir).select("p_partkey", F.size(trace.labelled(blank)).cast("long").alias("labelled"))


_STATE = "CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'edit' END"


@query(f"""WITH e AS (SELECT event_id, event_type, {_STATE} AS d, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events)
SELECT event_id, stamp, CASE d WHEN 'accept' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE '' END AS badge,
  CASE d WHEN 'accept' THEN 'Approved by human review on ' || stamp[:10] || ' — marked as commerce-ready.' WHEN 'reject' THEN 'Rejected by human review on ' || stamp[:10] || ' — excluded from the catalogue and CSV exports.' WHEN 'edit' THEN 'Edited on ' || stamp[:10] || ' — corrections saved, still awaiting a final Accept/Reject decision.' ELSE '' END AS banner,
  CASE event_type WHEN 'purchase' THEN 'fetched' WHEN 'error' THEN 'pdf skipped' ELSE 'failed' END AS document, CASE WHEN event_type = 'error' THEN 'n/a' ELSE 'HIGH' END AS confidence FROM e""")
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp, decision = trace.iso_time(F.col("ts")), F.expr(_STATE)
    status = F.expr("CASE event_type WHEN 'purchase' THEN 'fetched' WHEN 'error' THEN 'pdf_skipped' WHEN 'click' THEN 'odd' END")
    return _read(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"), trace.verdict_label(decision).alias("badge"), trace.verdict_text(decision, stamp).alias("banner"), trace.document_label(status).alias("document"), trace.confidence_label(F.expr("CASE WHEN event_type <> 'error' THEN 'HIGH' END")).alias("confidence"))


# -- Reports and bad rows --------------------------------------------------------------------------------------------
_REPORT = _SCORED_SQL + ", mis AS (SELECT count(*) AS missing FROM (SELECT p_partkey FROM attr GROUP BY p_partkey HAVING count(*) FILTER (WHERE coalesce(value, '') <> '') > 0 AND count(*) FILTER (WHERE coalesce(value, '') <> '' AND coalesce(source, '') <> '') = 0))"


@query(_REPORT + " SELECT count(*) AS \"rows\", 1.0::DOUBLE AS success_rate, round(avg(CAST(status = 'LOW' OR flagged AS INT)), 4) AS review_rate, CAST(0 AS BIGINT) AS failures, max(missing) AS missing_sources, round(avg(overall), 4) AS mean_confidence FROM st, mis")
def scale_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.scale_report(_scored(spark, sf_dir))


@query(f"WITH {q._ATTR_SQL} SELECT count(*) FILTER (WHERE value IS NOT NULL) AS claims, count(*) FILTER (WHERE value IS NOT NULL AND trim(coalesce(source, '')) <> '') AS \"grounded\", round(count(*) FILTER (WHERE value IS NOT NULL AND trim(coalesce(source, '')) <> '') / count(*) FILTER (WHERE value IS NOT NULL), 4) AS rate FROM attr")
def grounding_with_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pooled_grounding(_products(spark, sf_dir), blanks_count=True, empty=0.0)


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 AND p_partkey % 5 = 0 THEN 'neither part number nor description' WHEN p_partkey % 7 = 0 THEN 'candidates are not a JSON list' END AS error, CASE WHEN NOT (p_partkey % 11 = 0 AND p_partkey % 5 = 0) AND p_partkey % 7 <> 0 THEN 1 END AS n_attributes FROM part")
def rows_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without content and rows with a broken reply come back as they are, and say why."""
    rows = standin.catalogue(standin.part(spark, sf_dir), "p_partkey").withColumn("Part_Desc", F.expr("CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE Part_Desc END"))
    rows = rows.withColumn("reply", F.expr("""CASE WHEN p_partkey % 7 = 0 THEN '[{"label": ' ELSE '[{"label": "Size", "candidate_value": "3"}]' END"""))
    done = run.enrich_safely(rows, q.References(standin.taxonomy(spark)))
    return done.select("p_partkey", F.col("_error").alias("error"), F.when(F.col("attributes").isNotNull(), F.size("attributes")).alias("n_attributes"))


@query("SELECT * FROM (VALUES ('VLV-100', 'HIGH', 'BALL VALVE BRS', 2), ('DW-7', 'HIGH', 'DISHWASHER 120V', 2)) AS t(mpn, status, invoice, n_attributes)")
def sample_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.sample_products(spark).select("mpn", "confidence.status", F.try_element_at("descriptions", F.lit("INVOICE_DESC")).alias("invoice"), F.size("attributes").alias("n_attributes"))


@query("""WITH p AS (SELECT CASE WHEN n_chars > 200 THEN '1' ELSE '' END AS said, row_number() OVER (ORDER BY doc_id) AS k FROM documents), e AS (SELECT CASE WHEN quality = 1 THEN '1' ELSE '' END AS want, row_number() OVER (ORDER BY toxic DESC, doc_id) AS k FROM labels),
h AS (SELECT count(*) AS n, round(avg(CAST(said = want AS INT)), 4) AS accuracy FROM p JOIN e USING (k)) SELECT f.field, n, accuracy, CASE WHEN n < 5 THEN 'fewer than 5 rows' END AS warning FROM h, (VALUES ('quality'), ('(overall)')) AS f(field)""")
def positional_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and expected values of another number and order, aligned by their positions."""
    predicted = _read(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN n_chars > 200 THEN '1' ELSE 'None' END").alias("quality"))
    expected = _read(spark, sf_dir, "labels").select("doc_id", "toxic", F.expr("CASE WHEN quality = 1 THEN ' 1 ' END").alias("quality"))
    return metrics.aligned_accuracy(predicted, expected, ["quality"], ["doc_id"], [F.desc("toxic"), "doc_id"])
