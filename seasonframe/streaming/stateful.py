"""Keyed streaming state: claims with a time to live of their own, and state changes in the order of events."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Microseconds of the time column, beside the columns of the stream (a name with a leading underscore would be changed).
MICROS = "time_in_micros"

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state where `transformWithState` needs it; the session's own setting
    comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class _Claims(StatefulProcessor):
    """The end of an id's newest claim. One timer per claim drops the state when nothing earlier can come."""

    def __init__(self, ttl: int, order: list[str]) -> None:
        self.ttl, self.order = ttl, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values([MICROS, *self.order], kind="stable")
        until = self.until.get()[0] if self.until.exists() else None
        first, times = [], came[MICROS].to_numpy()
        at = 0
        while at < len(times):
            if until is None or times[at] >= until:
                first.append(at)
                until = int(times[at]) + self.ttl
            # The next row that finds the id free again.
            at = max(at + 1, int(times.searchsorted(until)))
        if first:
            self.until.update((until,))
            self.handle.registerTimer(until // 1000 + 1)
            yield came.iloc[first].drop(columns=MICROS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.until.exists() and self.until.get()[0] < timerValues.getCurrentWatermarkInMs() * 1000:
            self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def claims(stream: DataFrame, id_cols: list[str], ts: str, ttl: str = "15 minutes", late: str = "15 minutes", order: list[str] | None = None) -> DataFrame:
    """The rows that claim an id: one at a time, and free again `ttl` after its claim, not after its last mention.

    A claim holds its id for rows of times before claim + ttl, earlier ones that come late included; a row at that
    time or after claims it anew. Rows of one micro-batch are taken in the order of time, then of `order`. Rows more
    than `late` behind the newest of earlier batches are dropped, and so is an id's state when its claim has ended
    before that. Start the stream inside `keyed_state`. A null time claims nothing.
    """
    spark = stream.sparkSession
    length = spark.range(1).select((F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {ttl}"))).alias("n")).first()["n"]
    timed = stream.where(F.col(ts).isNotNull()).withColumn(MICROS, F.unix_micros(ts)).withWatermark(ts, late)
    return timed.groupBy(*id_cols).transformWithStateInPandas(
        _Claims(int(length), list(order or [])), stream.schema, "append", "EventTime")


class _Changes(StatefulProcessor):
    """An entity's last settled state and the rows that wait for the watermark to pass them."""

    def __init__(self, entity: list[str], at: str, fields: list[str], state: T.StructType, names: list[str]) -> None:
        self.entity, self.at, self.fields, self.state, self.names = entity, at, fields, state, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state)
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("us", T.LongType()), *self.state.fields]))
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            values = part[[MICROS, *self.fields]].astype(object).where(part[[MICROS, *self.fields]].notna(), None)
            self.waiting.appendList([tuple(_plain(v) for v in row) for row in values.itertuples(index=False)])
            first = int(part[MICROS].min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest)
        return iter([])

    def _wake(self, us: int) -> None:
        ms = us // 1000 + 1
        if self.timer.exists():
            if self.timer.get()[0] <= ms:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.timer.update((ms,))
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        settled_before = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(map(tuple, self.waiting.get()), key=_sort_key)
        settled = [r for r in rows if r[0] < settled_before]
        rest = rows[len(settled):]
        previous = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for us, *fields in settled:
            if previous is not None and tuple(fields) != previous:
                out.append((*key, us, *fields, *previous))
            previous = tuple(fields)
        if settled:
            self.last.update(previous)
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.timer.clear()
        if rest:
            self._wake(rest[0][0])
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _plain(value: Any) -> Any:
    return value.item() if hasattr(value, "item") else value


def _sort_key(row: tuple) -> tuple:
    """Time, then fields with nulls first, as Spark orders structs."""
    return (row[0], *[(v is not None, v) for v in row[1:]])


def state_changes_stream(stream: DataFrame, entity: list[str], at: str, fields: list[str], late: str = "1 hour") -> DataFrame:
    """(entity, at, fields, previous_<field>) of rows whose fields differ from the entity's row before.

    State is kept by entity, so a batch touches the entities it names. Rows wait until the watermark, `late` behind the
    newest time, has passed them, so rows that come out of order are compared in their order of time, and the result
    is that of `state_changes` over all rows that are not later than that; rows of one time are ordered by the
    fields, nulls first. The last rows of a stream settle when a later time arrives. Rows with a null time or a null
    part of the entity are left out. Fields are flat values. Start the stream inside `keyed_state`.
    """
    state = T.StructType([stream.schema[f] for f in fields])
    shape = T.StructType([*[stream.schema[e] for e in entity], T.StructField(MICROS, T.LongType()), *state.fields,
                          *[T.StructField(f"previous_{f.name}", f.dataType) for f in state.fields]])
    named = stream.where(F.col(at).isNotNull())
    for e in entity:
        named = named.where(F.col(e).isNotNull())
    timed = named.select(*entity, at, *fields).withColumn(MICROS, F.unix_micros(at)).withWatermark(at, late)
    changed = timed.groupBy(*entity).transformWithStateInPandas(
        _Changes(entity, at, fields, state, shape.names), shape, "append", "EventTime")
    return changed.select(*entity, F.timestamp_micros(MICROS).alias(at), *fields, *[f"previous_{f}" for f in fields])
