"""Packets cut out of keyed streams, with the unfinished end of each key as state.

``packet_stream`` takes pieces of text as they come.  What stands before a delimiter is a packet; what stands after the
last one is kept in the state store and begins the next.  Pieces have a place in their key's stream: one that was seen
already counts once (a sender that repeats itself changes nothing), pieces of one micro-batch are put in order.
With ``idle_ms`` a key without new pieces for so long gives its unfinished end as a last packet, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State with several variables and timers needs the RocksDB store."""
    spark.conf.set(_STORE, _ROCKS)


class Carry(StatefulProcessor):
    """State of a key: the unfinished text, the number of the next packet, and the last place that was seen."""

    def __init__(self, delimiter: str, idle_ms: int | None):
        self.delimiter, self.idle_ms = delimiter, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = handle.getValueState("rest", "text string, n long, place long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        text, n, place = self.rest.get() if self.rest.exists() else ("", 0, None)
        new = pd.concat(rows).sort_values("place", kind="stable").drop_duplicates("place")
        if place is not None:
            new = new[new["place"] > place]
        if len(new):
            *packets, text = (text + "".join(new["piece"])).split(self.delimiter)
            self.rest.update((text, n + len(packets), int(new["place"].iloc[-1])))
            if packets:
                yield self._out(key, n, packets, True)
        if self.idle_ms is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.rest.exists():
            text, n, _ = self.rest.get()
            self.rest.clear()
            if text:
                yield self._out(key, n, [text], False)

    @staticmethod
    def _out(key: Any, n: int, packets: list[str], complete: bool) -> pd.DataFrame:
        return pd.DataFrame({"group": [key[0]] * len(packets), "n": range(n, n + len(packets)), "packet": packets, "complete": complete})

    def close(self) -> None:
        pass


def packet_stream(pieces: DataFrame, key: str, text: str, order: str, delimiter: str = "\n", idle_ms: int | None = None) -> DataFrame:
    """(key, n, packet, complete) of a streaming DataFrame: packets numbered within their key from 0."""
    if not delimiter:
        raise ValueError("an empty delimiter")
    use_state_store(pieces.sparkSession)
    kind = pieces.schema[key].dataType.simpleString()
    rows = pieces.where(F.col(key).isNotNull()).select(F.col(key).alias("group"), F.coalesce(F.col(text), F.lit("")).alias("piece"), F.col(order).cast("long").alias("place"))
    out = rows.groupBy("group").transformWithStateInPandas(Carry(delimiter, idle_ms), f"group {kind}, n long, packet string, complete boolean", "Append", "None" if idle_ms is None else "ProcessingTime")
    return out.withColumnRenamed("group", key)
