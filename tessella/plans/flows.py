"""Further named queries: replayed reviews and what can't count, tables side by side, stages in an envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import positions, review, understanding
from tessella.plans import envelope, standin
from tessella.plans.queries import _read, query

_DECISION = "CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'edit' WHEN 'signup' THEN 'edit' ELSE 'view' END"
_KEY = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 17 = 0 THEN 'gone' ELSE concat('P', cast(user_id AS string)) END"
_AT = "CASE WHEN event_id % 19 > 0 THEN ts END"
_SAID = "CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN concat('said ', cast(event_id AS string)) END"
_LISTED = "CASE WHEN event_type IN ('click', 'signup') AND event_id % 3 = 0 THEN concat('list ', cast(event_id AS string)) END"
_EVENTS = f"ev AS (SELECT {_KEY} AS key, {_DECISION} AS decision, {_AT} AS happened, event_id AS seq, {_LISTED} AS attributes, {_SAID} AS descriptions FROM events)".replace("string", "VARCHAR")
_PROBLEM = "CASE WHEN coalesce(trim(key), '') = '' THEN 'no key' WHEN decision = 'view' THEN 'bad decision' WHEN happened IS NULL THEN 'no time' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(*(F.expr(e).alias(n) for n, e in (("key", _KEY), ("decision", _DECISION), ("at", _AT), ("seq", "event_id"), ("attributes", _LISTED), ("descriptions", _SAID))))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.part(spark, sf_dir).select(F.expr("concat('P', cast(p_partkey AS string))").alias("key"), F.col("p_type").alias("attributes"), F.col("p_name").alias("descriptions"))


@query(f"""WITH {_EVENTS}, ok AS (SELECT *, strftime(happened, '%Y%m%d%H%M%S%f') || lpad(CAST(seq AS VARCHAR), 12, '0') AS moment FROM ev WHERE {_PROBLEM} IS NULL),
last AS (SELECT key, arg_max(decision, moment) AS decision, arg_max(attributes, moment) FILTER (WHERE decision = 'edit' AND attributes IS NOT NULL) AS a, arg_max(descriptions, moment) FILTER (WHERE decision = 'edit' AND descriptions IS NOT NULL) AS d FROM ok GROUP BY key)
SELECT 'P' || p_partkey AS key, coalesce(a, p_type) AS attributes, coalesce(d, p_name) AS descriptions, decision FROM part LEFT JOIN last ON key = 'P' || p_partkey""")
def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decisions over all products; each edit merges only the columns that it brings."""
    return review.replay(_products(spark, sf_dir), _events(spark, sf_dir)).drop("at")


@query(f"WITH {_EVENTS} SELECT key, decision, seq, coalesce({_PROBLEM}, 'unknown key') AS error FROM ev WHERE {_PROBLEM} IS NOT NULL OR key NOT IN (SELECT 'P' || p_partkey FROM part)")
def review_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.dead_letters(_products(spark, sf_dir), _events(spark, sf_dir)).select("key", "decision", "seq", "error")


@query("""WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place FROM part), b AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events)
SELECT place, p_partkey, event_id FROM a JOIN b USING (place)""")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of different length, aligned by their positions in orders of their own."""
    left = positions.ordered_index(standin.part(spark, sf_dir), F.desc("p_retailprice"), "p_partkey")
    right = positions.ordered_index(_read(spark, sf_dir, "events").select("ts", "event_id"), "ts", "event_id")
    return positions.side_by_side(left, right).select(F.col("row_index").alias("place"), "p_partkey", "other.event_id")


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'none' ELSE CAST(p_size AS VARCHAR) END AS size, p_partkey % 7 AS parts FROM part)
SELECT p_partkey, CASE WHEN size = 'none' THEN 'sizes: size is no number' WHEN parts = 0 THEN 'shares: nothing to share' END AS error, CASE WHEN size <> 'none' AND parts > 0 THEN CAST(size AS INTEGER) // parts END AS share FROM r""")
def staged_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's first fault stops it; the others go through all stages."""
    rows = standin.part(spark, sf_dir).select("p_partkey", F.expr("CASE WHEN p_partkey % 10 = 0 THEN 'none' ELSE cast(p_size AS string) END").alias("size"), (F.col("p_partkey") % 7).alias("parts"), F.col("p_partkey").alias("row_index"))
    stages = [
        envelope.Stage("sizes", lambda df: df.withColumn("n", F.col("size").cast("int")), lambda df: F.when(F.expr("try_cast(size AS int) IS NULL"), "size is no number")),
        envelope.Stage("shares", lambda df: df.withColumn("share", F.expr("cast(n div parts AS int)")), lambda df: F.when(F.col("parts") == 0, "nothing to share")),
    ]
    done = envelope.through(rows, stages)
    failed = F.col(envelope.FAILED)
    return done.select(F.coalesce("p_partkey", F.col(f"{envelope.RAW}.p_partkey")).alias("p_partkey"), F.when(failed.isNotNull(), F.concat_ws(": ", failed["stage"], failed["reason"])).alias("error"), "share")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Motor' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'motor ' || p_name || ' red' ELSE p_name END AS searched FROM part""")
def understood_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for the model answers for every third product; others state nothing."""
    rows = standin.part(spark, sf_dir).select("p_partkey", F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("mpn"), F.col("p_name").alias("part_desc"))
    number = F.regexp_extract("id", "Part Number: M([0-9]+)", 1).cast("long")
    answer = F.when(number % 3 == 0, F.lit('```json\n{"product_type": "Motor", "tone": "red", "size": null}\n```')).when(number % 3 == 1, "I can't tell.")
    done = understanding.understood(rows, lambda q: q.select("id", answer.alias("answer")))
    return done.select("p_partkey", F.try_element_at("facts", F.lit("product_type")).alias("kind"), understanding.search_text(F.col("part_desc"), F.col("facts"), F.col("extras")).alias("searched"))
