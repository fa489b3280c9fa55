"""A stream of file changes that keeps an index up to date."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.inverted import LexicalIndex
from lodestone.operators.shared import cut
from lodestone.operators.store import BucketTable
from lodestone.sources.files import in_skipped_folder, skipped_path

DEBOUNCE = "500 milliseconds"


def debounced(events: DataFrame, *, ts: str = "ts", path: str = "file", gap: str = DEBOUNCE, late: str | None = None) -> DataFrame:
    """One row for each burst of a path's events (no longer apart than `gap`): its time span, number and last operation.

    `late` is the watermark of a stream: events that come later than that are dropped, and state before it is freed.
    """
    source = events.withWatermark(ts, late) if late else events
    last = F.max_by("op", F.col(ts))
    found = source.groupBy(path, F.session_window(ts, gap)).agg(F.count("*").alias("events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), last.alias("op"))
    return found.drop("session_window")


def known_changes(events: DataFrame, *, gap: str = DEBOUNCE, late: str = "0 seconds") -> DataFrame:
    """The changes (file, op, content, last_ts) of a stream of events (ts, file, op, content) that matter.

    A file's events no longer apart than `gap` are one burst, and its last event is the change. It comes out when the
    watermark (`late` behind the latest event) has passed its end, so one that goes on in a later batch is one change; or when a
    later event of the file shows that it has ended. What comes after that and is older than what was seen counts no more.
    Content that is the file's last one is no change, nor is the removal of a file that isn't there; removals carry no content.

    The state of a file is the hash of its content, and a burst while it lasts; that of a removed file is freed.
    """
    wait = int(events.sparkSession.sql(f"select unix_micros(timestamp_seconds(0) + interval {gap})").first()[0])

    def run(key, frames, state):
        hashed, ts, op, content = state.get if state.exists else (None, None, None, None)
        found = []

        def settle() -> None:
            nonlocal hashed, ts, op, content
            now = None if op == "Removed" or content is None else hashlib.sha256(content.encode()).hexdigest()
            if now != hashed and (now is not None or op == "Removed"):
                found.append((key[0], op, None if op == "Removed" else content, pd.Timestamp(ts, unit="us")))
                hashed = now
            ts = op = content = None

        if state.hasTimedOut:
            settle()
        else:
            rows = pd.concat(frames)
            rows = rows.assign(at=rows["ts"].astype("datetime64[us]").astype("int64")).sort_values(["at", "op"], kind="stable")
            for r in rows.itertuples(index=False):
                if ts is not None and r.at - ts > wait:
                    settle()
                if ts is None or r.at >= ts:
                    ts, op, content = r.at, r.op, r.content
            if (ts + wait) // 1000 <= state.getCurrentWatermarkMs():
                settle()
        if ts is None and hashed is None:
            if state.exists:
                state.remove()
        else:
            state.update((hashed, ts, op, content))
            if ts is not None:
                state.setTimeoutTimestamp((ts + wait) // 1000)
        if found:
            yield pd.DataFrame(found, columns=["file", "op", "content", "last_ts"])

    watched = events.select("ts", "file", "op", "content").where("ts is not null and file is not null").withWatermark("ts", late).groupBy("file")
    return watched.applyInPandasWithState(run, "file string, op string, content string, last_ts timestamp", "content_sha256 string, ts long, op string, content string", "append", "EventTimeTimeout")


def apply_changes(index: LexicalIndex, table: BucketTable | None, index_id: str, batch: DataFrame, number: int, chunker: Callable[[DataFrame], DataFrame]) -> None:
    """Bring an index (and its chunk table) up to date with a batch of changes (file, op, content, last_ts). Running a batch twice changes nothing, so a restarted stream is safe."""
    latest = batch.groupBy("file").agg(F.max_by(F.struct("op", "content"), F.struct("last_ts", "op")).alias("e")).select("file", "e.op", "e.content")
    last = cut(latest.where(~in_skipped_folder(F.col("file")) & ~skipped_path(F.col("file"), F.coalesce(F.octet_length("content"), F.lit(0)))), "changes")
    gone = last.where("op = 'Removed' or content is not null").select("file")
    if gone.isEmpty():
        return
    new = cut(chunker(last.where("op = 'Modified' and content is not null").select("file", "content")).withColumn("index_id", F.lit(index_id)), "changed-chunks")
    if table is not None:
        table.replace(index_id, gone, new)
    index.update(number + 1, gone.withColumn("index_id", F.lit(index_id)), new)


def follow(events: DataFrame, index: LexicalIndex, index_id: str, chunker: Callable[[DataFrame], DataFrame], checkpoint: str, *, table: BucketTable | None = None, gap: str = DEBOUNCE, late: str = "0 seconds", **trigger) -> StreamingQuery:
    """Start the stream (ts, file, op, content) into an index: bursts become one change, and changes without effect go."""
    sink = known_changes(events, gap=gap, late=late).writeStream.foreachBatch(lambda batch, number: apply_changes(index, table, index_id, batch, number, chunker))
    return sink.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
