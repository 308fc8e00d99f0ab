"""Web pages as a Spark data source: one row for each address, with its status, text and error.

The source deals addresses by host, so that a host is asked by one task only: politeness is a
bound for each host, whatever the number of tasks. A task asks its hosts' addresses with a few
threads, each request has a timeout, and what fails is a row with its reason, never a
failed task. Rows keep the place of their address, so the order of the input can be had again.
For addresses that are rows of a table, fetched_pages() does the same over Arrow batches.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.functions.udfs import page_text

SCHEMA = "place long, url string, status string, chars int, text string, error string"
#: Texts of so few characters are no documents.
LEAST_TEXT = 50
AGENT = "Mozilla/5.0 (compatible; catalogue-enrichment)"
#: Bytes of a page read at most: what a timeout is for time. A longer page is an error, not a part of a page.
MOST_BYTES = 20_000_000


@dataclass(frozen=True)
class Limits:
    """timeout: seconds a request may take between two bytes; workers: requests at once in a task."""

    timeout: float = 3.0
    workers: int = 4


def _get(url: str, timeout: float) -> str:
    with urlopen(Request(url, headers={"User-Agent": AGENT, "Accept-Encoding": "gzip, deflate"}), timeout=timeout) as answer:  # raises for statuses from 400 on
        body = answer.read(MOST_BYTES + 1)
        if len(body) > MOST_BYTES:
            raise ValueError(f"more than {MOST_BYTES} bytes")
        kind = answer.headers.get("Content-Encoding", "")
        body = gzip.decompress(body) if kind == "gzip" else zlib.decompress(body) if kind == "deflate" else body
        return body.decode(answer.headers.get_content_charset() or "utf-8", "replace")


def fetch(place: int, url: str | None, limits: Limits, get: Callable[[str, float], str] = _get) -> tuple:
    """One row of SCHEMA; documents of type PDF are not asked for."""
    if url is None or urlsplit(url).scheme not in ("http", "https"):
        return place, url, "failed", None, None, "no web address"
    if url.lower().endswith(".pdf"):
        return place, url, "pdf_skipped", None, None, None
    try:
        text = page_text(get(url, limits.timeout))
    except Exception as e:  # the row's, whatever it is
        return place, url, "failed", None, None, f"{type(e).__name__}: {e}"[:160]
    if len(text) <= LEAST_TEXT:
        return place, url, "failed", len(text), None, f"no usable text ({len(text)} chars)"
    return place, url, "fetched", len(text), text, None


def _host(url: str | None) -> str:
    return (urlsplit(url or "").netloc or "").lower()


class _Hosts(InputPartition):
    def __init__(self, asked: list[tuple[int, str | None]]) -> None:
        self.asked = asked


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self._addresses: list[str | None] = json.loads(options["addresses"])
        self._limits = Limits(float(options.get("timeout", Limits.timeout)), max(1, int(options.get("workers", Limits.workers))))
        self._tasks = max(1, int(options.get("tasks", "16")))

    def partitions(self) -> list[InputPartition]:
        """Hosts dealt to tasks, the host with most addresses first, each to the task with fewest so far."""
        hosts: dict[str, list[tuple[int, str | None]]] = {}
        for place, url in enumerate(self._addresses):
            hosts.setdefault(_host(url), []).append((place, url))
        tasks: list[list[tuple[int, str | None]]] = [[] for _ in range(min(self._tasks, max(1, len(hosts))))]
        for own in sorted(hosts.values(), key=len, reverse=True):
            min(tasks, key=len).extend(own)
        return [_Hosts(t) for t in tasks]

    def read(self, partition: _Hosts) -> Iterator[tuple]:
        with ThreadPoolExecutor(self._limits.workers) as pool:
            yield from pool.map(lambda a: fetch(*a, self._limits), partition.asked)


class PageSource(DataSource):
    """Options: addresses (a JSON list), timeout, workers, tasks."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PageReader:
        return PageReader(dict(self.options))


def read_pages(spark: SparkSession, addresses: list[str | None], limits: Limits = Limits(), tasks: int = 16) -> DataFrame:
    """SCHEMA for a list of addresses that the driver holds."""
    spark.dataSource.register(PageSource)
    return spark.read.format("pages").options(addresses=json.dumps(addresses), timeout=str(limits.timeout), workers=str(limits.workers), tasks=str(tasks)).load()


def fetched_pages(sources: DataFrame, limits: Limits = Limits(), tasks: int = 16) -> DataFrame:
    """sources(url, ...) with status, chars, text and error. Each address is asked once, those of a host in one task; a host
    with very many addresses takes its time alone, as it must. Null addresses fail."""
    asked = sources.select("url").distinct()
    dealt = asked.repartition(tasks, F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(limits.workers) as pool:
            for batch in batches:
                for k in range(0, batch.num_rows, 64):  # as many pages as are held at once
                    rows = list(pool.map(lambda u: fetch(0, u, limits)[1:], batch.column(0).slice(k, 64).to_pylist()))
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["url", "status", "chars", "text", "error"])

    pages = dealt.mapInArrow(run, "url string, status string, chars int, text string, error string").withColumnRenamed("url", "_url")
    return sources.join(pages, sources["url"].eqNullSafe(F.col("_url")), "left").drop("_url")
