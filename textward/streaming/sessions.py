"""Session state over a stream of scanned turns, and live scanning of a folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textward.operators.sessions import MAX_HISTORY, MAX_TURNS, TTL
from textward.plans.scan import Scanner

OUTPUT = "session_id string, turn_count int, cumulative_score double, matched_signatures array<string>, last_accessed timestamp, closed boolean"
STATE = "turns int, score double, signatures array<string>, last timestamp"


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    def row(turns, score, signatures, last, closed) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "turn_count": [turns], "cumulative_score": [score], "matched_signatures": [list(signatures)], "last_accessed": [last], "closed": [closed]})

    if state.hasTimedOut:
        turns, score, signatures, last = state.get
        state.remove()
        yield row(turns, score, signatures, last, True)
        return
    turns, score, signatures, last = state.get if state.exists else (0, 0.0, [], None)
    frame = pd.concat(list(frames)).sort_values(["ts", "request_id"], kind="stable")
    for ts, value, found in zip(frame["ts"], frame["score"], frame["signatures"]):
        if last is not None and (ts - last).total_seconds() >= TTL:
            yield row(turns, score, signatures, last, True)
            turns, score, signatures, last = 0, 0.0, [], None
        if turns < MAX_TURNS:
            turns, score, last = turns + 1, score + (0.0 if pd.isna(value) else float(value)), ts
            signatures = (list(signatures) + list(found if found is not None else []))[-MAX_HISTORY:]
    state.update((turns, score, list(signatures), last))
    state.setTimeoutTimestamp(int(last.timestamp() * 1000) + TTL * 1000)
    yield row(turns, score, signatures, last, False)


def session_states(turns: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The state of each session after each batch, and once more with ``closed`` when it has timed out.

    ``turns`` is a stream of session_id, request_id, ts, score, signatures. State is keyed by session and bounded
    (MAX_TURNS, MAX_HISTORY); event time drives the time-out. Rows without session or time are left out.
    """
    good = turns.where("session_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    return good.groupBy("session_id").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_requests(spark: SparkSession, folder: str, schema, fmt: str = "parquet", delay: str = "1 hour") -> DataFrame:
    """A stream of scan requests from a folder, each request once within the watermark."""
    rows = spark.readStream.schema(schema).format(fmt).load(folder)
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def scan_stream(requests: DataFrame, scanner: Scanner) -> DataFrame:
    """Scanned requests: the batch plan on a stream (narrow, no state)."""
    return scanner.scan_both(requests)


def write(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what there is, batch by batch, with a sink that may fail without ending the query."""

    def safely(batch: DataFrame, number: int) -> None:
        try:
            sink(batch, number)
        except Exception:  # noqa: BLE001  (logging must never stop scanning)
            pass

    return df.writeStream.foreachBatch(safely).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(requests: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Declarative counterpart: session windows per session_id with counts."""
    return requests.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("turns"))
