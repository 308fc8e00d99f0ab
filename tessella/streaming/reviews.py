"""Review decisions as a stream: one small state machine for each product.

The state of a key is its last decision and, for each editable column, the last edit that brought
it, each with its time; so events may come late, twice or in any order, and the state is that of
review.replay() over the same events. Keys are known from the products that the stream starts
with. What can't count goes to a table of dead letters with its reason, and is never dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessella.operators.review import EDITABLE, problem

#: Editable columns travel as JSON text, so that their types are the products' own.
EVENT = "key string, decision string, at timestamp, seq long, " + ", ".join(f"{c} string" for c in EDITABLE)
#: Times are microseconds inside.
STATE = "decision string, at long, seq long, " + ", ".join(f"{c} string, {c}_at long, {c}_seq long" for c in EDITABLE)
OUTPUT = "key string, decision string, at long, " + ", ".join(f"{c} string" for c in EDITABLE) + ", error string, event string"
_NAMES = [c.split()[0] for c in STATE.split(", ")]
#: Needed by stateful processors.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _later(at: int, seq: int | None, than_at: int | None, than_seq: int | None) -> bool:
    return than_at is None or (at, seq or 0) >= (than_at, than_seq or 0)


def step(state: dict[str, Any], event: Row) -> dict[str, Any]:
    """The state after a valid event."""
    after = dict(state)
    if _later(event.at, event.seq, state["at"], state["seq"]):
        after |= {"decision": event.decision, "at": event.at, "seq": event.seq}
    if event.decision == "edit":
        for c in EDITABLE:
            if event[c] is not None and _later(event.at, event.seq, state[f"{c}_at"], state[f"{c}_seq"]):
                after |= {c: event[c], f"{c}_at": event.at, f"{c}_seq": event.seq}
    return after


class Reviews(StatefulProcessor):
    """Keyed by product; initial state: the products' editable columns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("review", STATE)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: Any) -> None:
        start = dict.fromkeys(_NAMES) | {c: initialState[c] for c in EDITABLE}
        self._state.update(tuple(start[n] for n in _NAMES))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self._state.get() if self._state.exists() else None
        state = None if held is None else dict(zip(_NAMES, held, strict=True))
        changed = False
        for event in rows:
            error = event.error or (None if state else "unknown key")
            if error:
                told = {n: event[n] for n in ("key", "decision", "at", "seq", *EDITABLE)}
                yield Row(key=event.key, decision=None, at=None, **dict.fromkeys(EDITABLE), error=error, event=json.dumps(told, sort_keys=True))
            else:
                state, changed = step(state, event), True
        if changed:
            self._state.update(tuple(state[n] for n in _NAMES))
            yield Row(key=key[0], decision=state["decision"], at=state["at"], **{c: state[c] for c in EDITABLE}, error=None, event=None)

    def close(self) -> None:
        pass


def review_states(events: DataFrame, products: DataFrame) -> DataFrame:
    """Streaming EVENT rows to OUTPUT rows, at being a timestamp: the new state of each product that a batch changes, and dead letters.
    products(key, and EDITABLE as JSON text)."""
    marked = events.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in EVENT.split(", "))).withColumn("error", problem(F.col("decision"), F.col("key"), F.col("at"))).withColumn("at", F.unix_micros("at"))
    first = products.select("key", *EDITABLE).dropDuplicates(["key"]).groupBy("key")
    return marked.groupBy("key").transformWithState(Reviews(), OUTPUT, "Update", "None", initialState=first).withColumn("at", F.timestamp_micros("at"))


def keep_reviews(events: DataFrame, products: DataFrame, out: str, dead: str, checkpoint: str) -> StreamingQuery:
    """States to out and dead letters to dead, a folder for each batch, so that a batch run twice replaces itself."""
    events.sparkSession.conf.set(*STORE)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("error IS NULL").drop("error", "event").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.where("error IS NOT NULL").select("key", "error", "event").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    return review_states(events, products).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_reviews(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each product that has one."""
    newest = Window.partitionBy("key").orderBy(F.desc("batch"))
    return spark.read.parquet(out).withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "batch")
