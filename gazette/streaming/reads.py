"""Read tracking over a stream of events (event_type, dispatch_id, record_id, reader_userid, ts, dwell_seconds).

open and overview: a card was opened, or only looked over.  mark: an item was read.  dwell: time spent on an item; counts
only once the item has been marked, and is clamped to a day.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["dispatch_id", "record_id", "reader_userid"]
DAY = 86_400


def opens(events: DataFrame) -> DataFrame:
    """first_read, last_read, read_count of each dispatch; an overview counts as no open.  Batch or stream (update mode)."""
    e = events.filter(F.col("event_type").isin("open", "overview"))
    return e.groupBy("dispatch_id").agg(F.min("ts").alias("first_read"), F.max("ts").alias("last_read"), F.count_if(F.col("event_type") == "open").alias("read_count"))


def marks(events: DataFrame) -> DataFrame:
    """read_at: the last mark of each dispatch, record and reader.  Batch or stream (update mode)."""
    return events.filter("event_type = 'mark'").groupBy(*KEYS).agg(F.max("ts").alias("read_at"))


def dwell_batch(events: DataFrame) -> DataFrame:
    """read_at and the longest dwell at or after the first mark of each dispatch, record and reader."""
    first = events.filter("event_type = 'mark'").groupBy(*KEYS).agg(F.min("ts").alias("first_mark"), F.max("ts").alias("read_at"))
    d = events.filter("event_type = 'dwell'").select(*KEYS, "ts", F.least(F.greatest(F.coalesce("dwell_seconds", F.lit(0)), F.lit(0)), F.lit(DAY)).alias("d"))
    longest = d.join(first, KEYS).filter("ts >= first_mark").groupBy(*KEYS).agg(F.max("d").alias("dwell"))
    return first.select(*KEYS, "read_at").join(longest, KEYS, "left").withColumn("dwell", F.coalesce("dwell", F.lit(0)))


def dwell_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: per key the first mark, the last mark and the longest dwell are kept."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, longest, early = state.get if state.exists else (None, None, 0, [])
        early = list(early or [])
        for b in batches:
            for kind, ts, sec in zip(b["event_type"], b["ts"], b["dwell_seconds"]):
                at = pd.Timestamp(ts).value // 1000
                if kind == "mark":
                    first = at if first is None or at < first else first
                    last = at if last is None or at > last else last
                elif kind == "dwell":
                    early.append(at)
                    early.append(int(min(max(0 if pd.isna(sec) else sec, 0), DAY)))
        if first is not None:
            pairs = list(zip(early[::2], early[1::2]))
            longest = max([longest, *(s for at, s in pairs if at >= first)])
            # what came before the first mark may yet count, if an earlier mark arrives late
            early = [x for at, s in pairs if at < first and s > longest for x in (at, s)]
        state.update((first, last, longest, early))
        if first is not None:
            yield pd.DataFrame({"dispatch_id": [key[0]], "record_id": [key[1]], "reader_userid": [key[2]], "read_at": [pd.Timestamp(last, unit="us")], "dwell": [int(longest)]})

    e = events.filter(F.col("event_type").isin("mark", "dwell")).select(*KEYS, "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("dwell_seconds").cast("double").alias("dwell_seconds"))
    return e.groupBy(*KEYS).applyInPandasWithState(step, "dispatch_id string, record_id long, reader_userid string, read_at timestamp, dwell int", "first long, last long, longest int, early array<long>", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, each, checkpoint: str, mode: str = "update") -> None:
    """Process what is there and stop; `each`(batch, id) is called with every batch that has rows."""

    def guarded(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            each(batch, n)

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(guarded).start().awaitTermination()
