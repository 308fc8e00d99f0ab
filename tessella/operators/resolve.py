"""Entity resolution: exact, normalised, then similar names of a master list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.storing import stored
from tessella.functions.text import entity_key, strip
from tessella.operators import similar

EXACT, NORMALISED, PASSED, CHOSEN = 1.0, 0.97, 0.35, 0.80
#: (id, options array<string>) to (id, answer); stands for a text model.
Chooser = Callable[[DataFrame], DataFrame]
_RESULT = ("name", "code", "confidence", "method")


def _master(master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By name (the last of equal names) and by key (the first); master has name, code, ordinal."""
    by_name = master.groupBy("name").agg(F.max_by("code", "ordinal").alias("code"))
    keyed = master.withColumn("k", entity_key("name")).where("k <> ''")
    by_key = keyed.groupBy("k").agg(F.min_by(F.struct("name", "code"), "ordinal").alias("m")).select("k", "m.name", "m.code")
    return by_name, by_key


def exact(values: DataFrame, master: DataFrame) -> DataFrame:
    by_name, _ = _master(master)
    return values.join(by_name, values["raw"] == by_name["name"], "left").select("raw", *_found(EXACT, "exact"))


def normalised(values: DataFrame, master: DataFrame) -> DataFrame:
    _, by_key = _master(master)
    keyed = values.withColumn("k", entity_key("raw"))
    return keyed.join(by_key, "k", "left").select("raw", *_found(NORMALISED, "normalized"))


def _found(confidence: float, method: str) -> list:
    hit = F.col("name").isNotNull()
    return [F.col("name"), F.col("code"), F.when(hit, F.lit(confidence)).alias("confidence"), F.when(hit, F.lit(method)).alias("method")]


def fuzzy(values: DataFrame, master: DataFrame, reject: float = 0.70) -> DataFrame:
    """The name whose key is most like the key of raw, of at least reject, earliest first. values are distinct."""
    near = similar.most_similar(values.select("raw", entity_key("raw").alias("a")), master.select("name", "code", "ordinal", entity_key("name").alias("b")), 1, reject)
    return near.select("raw", "name", "code", F.round("score", 4).alias("confidence"), F.lit("fuzzy").alias("method"))


def options(values: DataFrame, master: DataFrame, k: int = 5) -> DataFrame:
    """values(raw), those that all rungs have left, to (id, options): the k most similar names of a master list, best first."""
    near = similar.most_similar(values.select("raw", entity_key("raw").alias("a")), master.select("name", "ordinal", entity_key("name").alias("b")), k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return near.groupBy(F.col("raw").alias("id")).agg(listed.alias("options"))


def by_model(values: DataFrame, master: DataFrame, choose: Chooser) -> DataFrame:
    """What a text model names for values(raw), each asked once with its most similar names. Any name of the list
    counts, but for case, marks and a bullet in front; other answers, NONE and no answer give no row."""
    asked = stored(options(values, master))
    said = first_answers(choose(asked))
    answer = entity_key(F.regexp_replace(strip("answer"), r"^[-•*]\s*", ""))
    _, by_key = _master(master)
    named = said.where(F.upper(strip("answer")) != "NONE").withColumn("k", answer).join(by_key, "k")
    return named.select(F.col("id").alias("raw"), "name", "code", F.lit(CHOSEN).alias("confidence"), F.lit("llm").alias("method"))


def first_answers(answers: DataFrame) -> DataFrame:
    """(id, answer): of several answers the first in alphabetical order, so that runs agree."""
    return answers.where(F.col("answer").isNotNull()).groupBy("id").agg(F.min("answer").alias("answer"))


def resolve(df: DataFrame, column: str, master: DataFrame, reject: float = 0.70, review: float = 0.82, blank_needs_review: bool = True, choose: Chooser | None = None) -> DataFrame:
    """df and column + _match: (name, code, confidence, method, needs_review). Work is done once for each distinct value, and
    what one rung finds is stored before the next, so no rung is worked out twice. choose: the text model's rung, off by default."""
    values = stored(df.select(F.col(column).alias("raw")).where(F.col(column).isNotNull() & (strip(column) != "")).distinct())
    trimmed = values.select("raw", strip("raw").alias("t"))
    whole = trimmed.select(F.col("t").alias("raw")).distinct()
    cheap = whole.alias("v").join(exact(whole, master).alias("e"), "raw").join(normalised(whole, master).alias("n"), "raw")
    pick = [F.coalesce(F.col(f"e.{c}"), F.col(f"n.{c}")) if c != "code" else F.when(F.col("e.name").isNotNull(), F.col("e.code")).otherwise(F.col("n.code")) for c in _RESULT]
    cheap = stored(cheap.select("raw", *(p.alias(c) for p, c in zip(pick, _RESULT, strict=True))))
    rest = cheap.where("name IS NULL").select("raw")
    every = cheap.where("name IS NOT NULL")
    rungs = [lambda left: fuzzy(left, master, reject)]
    if choose is not None:
        rungs.append(lambda left: by_model(left, master, choose))
    for rung in rungs:
        found = stored(rung(rest).select("raw", *_RESULT))
        every, rest = every.unionByName(found), rest.join(found.select("raw"), "raw", "left_anti")
    every = every.unionByName(rest.select("raw", *(F.lit(None).cast("string").alias(c) for c in ("name", "code")), F.lit(0.0).alias("confidence"), F.lit("unresolved").alias("method")))
    flag = (F.col("confidence") < review) & (F.col("method") != "llm")
    every = trimmed.join(every.withColumnRenamed("raw", "t"), "t").select(F.col("raw").alias("_raw"), F.struct(*_RESULT, flag.alias("needs_review")).alias("_match"))
    blank = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("code"), F.lit(0.0).alias("confidence"), F.lit("unresolved").alias("method"), F.lit(blank_needs_review).alias("needs_review"))
    return df.join(every, df[column] == every["_raw"], "left").withColumn(f"{column}_match", F.coalesce("_match", blank)).drop("_raw", "_match")


def pass_through(df: DataFrame, column: str) -> DataFrame:
    """What resolve() gives where there is no master list."""
    return df.withColumn(f"{column}_match", F.struct(F.col(column).alias("name"), F.lit(None).cast("string").alias("code"), F.lit(PASSED).alias("confidence"), F.lit("passthrough").alias("method"), F.lit(True).alias("needs_review")))
