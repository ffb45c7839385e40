"""Event-time windows and state over batch or streaming events, and incremental indexing of arriving files.

The same functions take a batch or a stream; a stream gets a watermark, so late rows are dropped and state is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def read_events(spark: SparkSession, folder: str, schema, files_a_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def _bounded(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows of ``events(ts, event_type, value)``."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    got = _bounded(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """(user_id, start, last_event, n) of runs of a user's events with less than ``gap`` between them."""
    got = _bounded(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("last_event"), F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), "last_event", "n")


def deduplicated(events: DataFrame, key: list[str], late: str = LATE) -> DataFrame:
    """The first of the rows with one key; on a stream within the watermark."""
    return _bounded(events, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


_FOLDED = "record long, state string, access_count long, last_access timestamp"
_KEPT = "state string, at timestamp, seq long, access_count long, last_access timestamp"


def fold_stream(log: DataFrame) -> DataFrame:
    """The fold of an event log ``(record, seq, ts, kind)`` kept up to date: every batch gives the records it changed."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, at, seq, count, last = kept.get if kept.exists else (None, None, None, 0, None)
        for part in parts:
            used = part[part["kind"] == "accessed"]
            count += len(used)
            if len(used):
                last = max(x for x in (last, used["ts"].max()) if x is not None)
            life = part[part["kind"].isin(["created", "superseded", "expired", "forgotten"])]
            for row in life.sort_values(["ts", "seq"]).itertuples():
                if at is None or (row.ts, row.seq) > (at, seq):
                    state, at, seq = row.kind, row.ts, row.seq
        kept.update((state, at, seq, count, last))
        shown = "active" if state == "created" else state
        yield pd.DataFrame({"record": [key[0]], "state": [shown], "access_count": [count], "last_access": [last]}).astype({"last_access": "datetime64[ns]"})

    return log.groupBy("record").applyInPandasWithState(update, _FOLDED, _KEPT, "update", GroupStateTimeout.NoTimeout)


def index_stream(files: DataFrame, apply, checkpoint: str, retries: int = 3):
    """Run ``apply(changed, batch)`` over each micro-batch's last version of each path, with retries; a started query."""

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy("path").agg(F.max_by(F.struct(*df.columns), "modified").alias("r")).select("r.*")
        for attempt in range(1, retries + 1):
            try:
                apply(last, number)
                return
            except Exception:
                if attempt == retries:
                    raise

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
