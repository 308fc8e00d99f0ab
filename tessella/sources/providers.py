"""Seams for services outside: page fetching and text models. Off by default; everything else is deterministic."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.udfs import html_text

LEAST_TEXT = 50
#: Parts of names of models that don't chat; fixed values.
NO_CHAT = ["whisper", "tts", "guard", "embed", "compound", "orpheus", "playai"]


def fetched(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """sources(url, ...) with status and text from a table pages(url, html): no PDF is read, short texts count as failed."""
    wanted = pages.join(sources.select("url").distinct(), "url", "left_semi")
    # Of several pages under one url the one of the least text stays, so that every run gives the same.
    texts = wanted.groupBy("url").agg(F.min("html").alias("html")).select("url", html_text("html").alias("_text"))
    joined = sources.join(texts, "url", "left")
    pdf = F.lower("url").endswith(".pdf")
    ok = ~pdf & (F.length("_text") > LEAST_TEXT)
    return joined.select(*sources.columns, F.when(pdf, "pdf_skipped").when(F.coalesce(ok, F.lit(False)), "fetched").otherwise("failed").alias("status"), F.when(ok, F.col("_text")).alias("text"))


@dataclass
class Pacing:
    """Least seconds between calls of one task, and waits after a refusal: doubling up to longest, a few times."""

    interval: float = 0.5
    retries: int = 3
    first_wait: float = 2.0
    longest: float = 15.0


class Refused(Exception):
    """The service asks to wait; seconds may say how long."""

    def __init__(self, seconds: float | None = None) -> None:
        super().__init__("refused")
        self.seconds = seconds


def paced(call: Callable[[str], str | None], pacing: Pacing = Pacing(), sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Callable[[str], str | None]:
    last = -1e9

    def run(prompt: str) -> str | None:
        nonlocal last
        wait = pacing.first_wait
        for turn in range(pacing.retries + 1):
            sleep(max(0.0, last + pacing.interval - clock()))
            last = clock()
            try:
                return call(prompt)
            except Refused as e:
                if turn == pacing.retries:
                    return None
                sleep(min(pacing.longest, e.seconds + 0.3 if e.seconds is not None else wait))
                wait = min(pacing.longest, 2 * wait)
        return None

    return run


def choose_model(active: Iterable[str], preferred: Sequence[str], default: str, override: str = "", excluded: Sequence[str] = NO_CHAT) -> str:
    """The model to ask: the override if there is one, else the first preferred that is active, else the first active in
    alphabetical order that is a chat model by its name, else the default."""
    if override.strip():
        return override.strip()
    names = sorted(active)
    chat = (n for n in names if not any(x in n for x in excluded))
    return next((p for p in preferred if p in names), None) or next(chat, default)


def answers(questions: DataFrame, connect: Callable[[], Callable[[str], str | None]], pacing: Pacing = Pacing(), tasks: int = 4, prompt: str = "id") -> DataFrame:
    """questions(id, ...) to (id, answer): each different id is asked once, by its prompt column.

    pacing is the budget of the whole job: questions are dealt over so many tasks, and each task waits so many times as
    long between its calls. connect is called once in a task and gives the function to call; what that raises is no answer."""
    own = replace(pacing, interval=pacing.interval * tasks)
    asked = questions.select(F.col("id").cast("string").alias("id"), F.col(prompt).cast("string").alias("_prompt")).dropDuplicates(["id"]).repartition(tasks, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for batch in batches:
            said = []
            for p in batch.column(1).to_pylist():
                ask = ask or paced(connect(), own)
                try:
                    said.append(ask(p) if p is not None else None)
                except Exception:  # one call's fault is no fault of the others
                    said.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["id", "answer"])

    return asked.mapInArrow(run, "id string, answer string")


def replies(df: DataFrame, prompt: str, connect: Callable[[], Callable[[str], str | None]] | None = None, pacing: Pacing = Pacing(), tasks: int = 4) -> DataFrame:
    """df and reply: null without a service. Equal prompts are asked once, within the budget of answers()."""
    if connect is None:
        return df.withColumn("reply", F.lit(None).cast("string"))
    said = answers(df.select(F.col(prompt).alias("id")).where(F.col(prompt).isNotNull()), connect, pacing, tasks)
    return df.join(said.select(F.col("id").alias("_asked"), F.col("answer").alias("reply")), df[prompt] == F.col("_asked"), "left").drop("_asked")
