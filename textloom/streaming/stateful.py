"""Streams: rate limits for each key, packets cut out of text, JSON messages, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIMITED = "user string, event_id long, at double, count long, accepted boolean"


def _step(state: tuple[int, float], at: float, limit: int, seconds: float) -> tuple[tuple[int, float], bool]:
    """One request: within the limit it counts; beyond it, it is refused until the frame that began last is over."""
    count, start = state
    if count >= limit:
        if at - start <= seconds:
            return state, False
        return (1, at), True
    return (count + 1, start), True


def rate_limit_batch(events: DataFrame, limit: int = 5, seconds: float = 3600.0) -> DataFrame:
    """(user, event_id, at, count, accepted) of (user, event_id, at): a sequential fold over each key, streamed by sorted rows.

    Rows of a key stay in order in one partition, but are never gathered: memory doesn't grow with a key's events.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, (0, 0.0)
        for pdf in batches:
            counts, ok = [], []
            for u, at in zip(pdf["user"], pdf["at"], strict=True):
                if u != user:
                    user, state = u, (0, at)
                state, accepted = _step(state, at, limit, seconds)
                counts.append(state[0])
                ok.append(accepted)
            yield pdf.assign(count=counts, accepted=ok)[["user", "event_id", "at", "count", "accepted"]]

    return events.select("user", "event_id", "at").repartition("user").sortWithinPartitions("user", "at", "event_id").mapInPandas(run, LIMITED)


def rate_limit_stream(events: DataFrame, limit: int = 5, seconds: float = 3600.0) -> DataFrame:
    """The same over a stream, with the count and the frame's start as state."""

    def run(key, batches, state):
        now = state.get if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values(["at", "event_id"])
            now = now or (0, float(pdf["at"].iloc[0]))
            counts, ok = [], []
            for at in pdf["at"]:
                now, accepted = _step(now, at, limit, seconds)
                counts.append(now[0])
                ok.append(accepted)
            yield pdf.assign(user=key[0], count=counts, accepted=ok)[["user", "event_id", "at", "count", "accepted"]]
        state.update(now)

    return events.groupBy("user").applyInPandasWithState(run, LIMITED, "count long, start double", "append", "NoTimeout")


def packets(lines: DataFrame, key: str, text: str, order: str, delimiter: str = "\n") -> DataFrame:
    """(key, n, packet) of a keyed, ordered byte stream: what stands between delimiters, over the borders of its rows."""
    whole = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "").alias("t"))
    parts = F.split(F.col("t"), "\\Q" + delimiter + "\\E")
    return whole.select(key, F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("n", "packet"))


def messages(c: str) -> Column:
    """Text of JSON messages: the extended text, the full text or the text."""
    j = F.col(c)
    return F.coalesce(F.get_json_object(j, "$.extended_tweet.full_text"), F.get_json_object(j, "$.full_text"), F.get_json_object(j, "$.text"))


def windowed(events: DataFrame, ts: str, size: str, by: list[str], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` in tumbling or sliding windows, for batches and streams."""
    e = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, by: list[str]) -> DataFrame:
    w = F.session_window(ts, gap)
    return events.groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *by, "n")


def as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """left with the latest earlier ``value`` of right for the same keys: one sort of the union, no range join."""
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.select(*by, ts, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn("as_of", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")
