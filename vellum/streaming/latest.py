"""The latest row of each key on a stream, kept in state, with rows that come late or again told apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vellum.operators.bucketed import Bucketed

STATUS = "status"
#: Microseconds and number of a key's latest row.
STATE = StructType([StructField("at", LongType()), StructField("tie", LongType())])


def _latest(time: str, tie: str, ttl_ms: int | None) -> Callable[[Any, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        newest: pd.DataFrame | None = None
        for some in parts:
            some = some if newest is None else pd.concat([newest, some])
            some = some.sort_values([time, tie], kind="stable")
            newest = some.iloc[-1:]
            if len(some) > 1:
                yield some.iloc[:-1].assign(**{STATUS: "late"})
        if newest is None:
            return
        at = int(newest[time].iloc[0].value // 1000), int(newest[tie].iloc[0])
        if best is not None and at <= tuple(best):
            yield newest.assign(**{STATUS: "late"})
            return
        state.update(at)
        if ttl_ms:
            # A time limit lies beyond the watermark.
            state.setTimeoutTimestamp(max(at[0] // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield newest.assign(**{STATUS: "new" if best is None else "updated"})

    return run


def latest_rows(stream: DataFrame, keys: list[str], time: str = "ts", tie: str = "event_id", ttl_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """Rows of ``stream`` with ``status``: the latest of its key so far is new or updated; those that are no later than it are late.

    A row is later than another by ``time``, then by the number ``tie``; a row that comes again is late. Rows without a time
    or number are left out. Of a batch's rows of a key one is new or updated at most. A key's state, two numbers, goes when
    the watermark, ``late`` behind the latest time seen, is ``ttl_ms`` past its row, or never; after that the next row counts as new,
    and rows behind the watermark are dropped.
    """
    own = stream.where(f"`{time}` is not null and `{tie}` is not null")
    schema = StructType([*stream.schema.fields, StructField(STATUS, StringType())])
    own = own.withWatermark(time, late) if ttl_ms else own
    mode = GroupStateTimeout.EventTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return own.groupBy(*keys).applyInPandasWithState(_latest(time, tie, ttl_ms), schema, STATE, "update", mode)


def keep_latest(stream: DataFrame, kept: Bucketed, checkpoint: str, time: str = "ts", tie: str = "event_id", ttl_ms: int | None = None, late: str = "1 hour") -> StreamingQuery:
    """Keep the latest row of each of the keys of ``kept`` in that table, which is as large as its keys are many.

    A batch that runs again after a loss changes nothing. The query goes through what there is, and stops.
    """

    def each(batch: DataFrame, number: int) -> None:
        kept.upsert(batch.where(f"{STATUS} <> 'late'").drop(STATUS), number)

    rows = latest_rows(stream, kept.keys, time, tie, ttl_ms, late)
    return rows.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
