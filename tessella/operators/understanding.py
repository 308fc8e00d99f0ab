"""What a description states about a product: facts by name, from a text model's reply, or none without a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import refdata
from tessella.functions.storing import stored
from tessella.functions.text import expand_abbreviations, join_parts
from tessella.operators import attributes
from tessella.operators.resolve import first_answers

#: (id) to (id, answer): id is the prompt, each asked once.
Answer = Callable[[DataFrame], DataFrame]


def prompt(mpn: Column, desc: Column) -> Column:
    """A part number as it is, and a description with its abbreviations written out."""
    given = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))
    return F.concat(F.lit("Part Number: "), given(mpn), F.lit("\nDescription: "), given(expand_abbreviations(desc)))


def understood(df: DataFrame, answer: Answer | None = None) -> DataFrame:
    """df(mpn, part_desc, ...) and facts, extras: maps of what the reply to prompt() states. Equal prompts are asked once; a
    reply that is no JSON object, or none at all, states nothing."""
    empty = F.create_map().cast("map<string,string>")
    if answer is None:
        return df.withColumns({"facts": empty, "extras": empty})
    asked = df.withColumn("_prompt", prompt(F.col("mpn"), F.col("part_desc")))
    questions = stored(asked.select(F.col("_prompt").alias("id")).where("id IS NOT NULL").distinct())
    known, others = attributes.facts(F.col("answer"), refdata.FACTS)
    said = first_answers(answer(questions)).select(F.col("id").alias("_id"), known.alias("_facts"), others.alias("_extras"))
    both = asked.join(said, asked["_prompt"] == said["_id"], "left")
    return both.withColumns({"facts": F.coalesce("_facts", empty), "extras": F.coalesce("_extras", empty)}).drop("_prompt", "_id", "_facts", "_extras")


def search_text(desc: Column, facts: Column, extras: Column) -> Column:
    """What classification reads: kind, description, application, industry, material, then all extras, in lower case."""
    fact = lambda name: F.coalesce(F.try_element_at(facts, F.lit(name)), F.lit(""))
    parts = (fact("product_type"), F.coalesce(desc, F.lit("")), fact("application"), fact("industry"), fact("material"), F.array_join(F.map_values(extras), " "))
    return F.lower(join_parts(" ", *parts))
