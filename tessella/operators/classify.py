"""Classification into a controlled taxonomy (ordinal, dept, class_name, fine, keywords)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.storing import stored
from tessella.functions.text import join_parts, strip
from tessella.operators import similar
from tessella.operators.resolve import Chooser, first_answers

ACCEPT, FUZZY_FLOOR, CHOSEN = 0.60, 0.30, 0.82
#: Letters of a keyword's beginning by which it is found.
GRAM = 3


def class_path(dept: Column, class_name: Column, fine: Column) -> Column:
    return F.concat_ws(">", dept, class_name, fine)


def split_path(path: Column) -> tuple[Column, Column, Column]:
    """Dept, class and fine of a path; missing levels are empty."""
    parts = F.filter(F.transform(F.split(path, ">"), F.trim), lambda p: p != "")
    return tuple(F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for k in range(3))


def search_text(*parts: Column) -> Column:
    return F.lower(join_parts(" ", *parts))


def by_keywords(texts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """texts(text), distinct: the entry with most keywords in the text, the earliest of equals; keywords count as substrings.

    An index of keywords by their first letters: a text's runs of as many letters meet only the keywords that begin with
    one of them, by an equality join, and those are then looked for whole. The best entry is an aggregate, so no text's
    hits are gathered anywhere. Texts and keywords may be of any number: Spark broadcasts the index if it is small, or
    shuffles both sides."""
    entry = F.struct("ordinal", "dept", "class_name", "fine")
    words = taxonomy.select(entry.alias("entry"), F.posexplode("keywords").alias("place", "word")).where("word IS NOT NULL").withColumn("gram", F.left("word", F.lit(GRAM)))
    # How long such beginnings are: GRAM letters, or those of shorter keywords.
    sizes = [r["n"] for r in words.select(F.length("gram").alias("n")).distinct().collect()]
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - (n - 1)), lambda at: F.substring("text", at, F.lit(n)))
    grams = F.array_distinct(F.concat(F.array().cast("array<string>"), *(F.when(F.length("text") >= n, runs(n)).otherwise(F.array().cast("array<string>")) if n else F.array(F.lit("")) for n in sizes)))
    met = texts.select("text", F.explode(grams).alias("gram")).join(words, "gram").where(F.contains("text", "word"))
    hits = met.groupBy("text", "entry").agg(F.count("*").alias("hits"))
    best = hits.groupBy("text").agg(F.max_by("entry", F.struct("hits", -F.col("entry.ordinal"))).alias("e"), F.max("hits").alias("hits"))
    return best.select("text", "e.dept", "e.class_name", "e.fine", F.least(F.lit(0.95), 0.5 + 0.15 * F.col("hits")).alias("confidence"), F.lit("keyword").alias("method"))


def _targets(taxonomy: DataFrame) -> DataFrame:
    words = F.concat_ws(" ", "fine", "class_name", "dept")
    return taxonomy.select("ordinal", "dept", "class_name", "fine", F.concat(F.lower(words), F.lit(" "), F.array_join("keywords", " ")).alias("b"))


def by_similarity(texts: DataFrame, taxonomy: DataFrame, k: int = 1, floor: float = FUZZY_FLOOR) -> DataFrame:
    """texts(text), distinct: the k entries whose words are most like the text, of at least floor."""
    near = similar.most_similar(texts.select(F.col("text").alias("raw"), F.col("text").alias("a")).where("a <> ''"), _targets(taxonomy), k, floor)
    return near.select(F.col("raw").alias("text"), "rank", "dept", "class_name", "fine", F.round("score", 4).alias("confidence"), F.lit("fuzzy").alias("method"))


def by_model(texts: DataFrame, taxonomy: DataFrame, choose: Chooser, k: int = 5) -> DataFrame:
    """What a text model chooses for texts(text), each asked once with the paths of its k most similar entries. A path of
    the taxonomy counts as it is, one of the k in any case; other answers, NONE and no answer give no row."""
    path = class_path(F.col("dept"), F.col("class_name"), F.col("fine"))
    near = by_similarity(texts, taxonomy, k, 0.0).select("text", "rank", path.alias("path"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"])
    asked = stored(near.groupBy(F.col("text").alias("id")).agg(listed.alias("options")))
    said = first_answers(choose(asked)).join(asked, "id").withColumn("answer", strip("answer"))
    paths = taxonomy.select(path.alias("path"), "ordinal", "dept", "class_name", "fine")
    known = paths.groupBy("path").agg(F.min_by(F.struct("dept", "class_name", "fine"), "ordinal").alias("e"))
    answer = F.coalesce(F.get(F.filter("options", lambda o: o == F.col("answer")), F.lit(0)), F.get(F.filter("options", lambda o: F.lower(o) == F.lower("answer")), F.lit(0)), F.col("answer"))
    named = said.select("id", answer.alias("path")).join(known, "path")
    return named.select(F.col("id").alias("text"), "e.dept", "e.class_name", "e.fine", F.lit(CHOSEN).alias("confidence"), F.lit("llm").alias("method"))


def classify(df: DataFrame, column: str, taxonomy: DataFrame, choose: Chooser | None = None) -> DataFrame:
    """df and classification: by keywords where there is a hit, else by similarity; what that leaves below ACCEPT goes to the
    text model, if there is one, and is flagged if it has no answer. Each distinct text once, each rung's finds stored."""
    names = ("text", "dept", "class_name", "fine", "confidence", "method")
    texts = stored(df.select(F.col(column).alias("text")).where(F.col(column) != "").distinct())
    every = stored(by_keywords(texts, taxonomy))
    rest = texts.join(every.select("text"), "text", "left_anti")
    near = by_similarity(rest, taxonomy).select(*names)
    if choose is not None:
        near = stored(near)
        open_ = rest.join(near.where(F.col("confidence") >= ACCEPT).select("text"), "text", "left_anti")
        said = stored(by_model(open_, taxonomy, choose).select(*names))
        every, near = every.unionByName(said), near.join(said.select("text"), "text", "left_anti")
    every = every.unionByName(near)
    result = F.struct("dept", "class_name", "fine", class_path(F.col("dept"), F.col("class_name"), F.col("fine")).alias("classpath"), "confidence", "method", (F.col("confidence") < ACCEPT).alias("needs_review"))
    none = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("dept", "class_name", "fine", "classpath")), F.lit(0.0).alias("confidence"), F.lit("unresolved").alias("method"), F.lit(True).alias("needs_review"))
    every = every.select(F.col("text").alias("_text"), result.alias("_class"))
    return df.join(every, df[column] == every["_text"], "left").withColumn("classification", F.coalesce("_class", none)).drop("_text", "_class")
