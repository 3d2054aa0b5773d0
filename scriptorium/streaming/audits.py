"""Checks over streams: documents as they arrive, and task events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scriptorium.operators.language import CLAIM_LANGUAGE, matches
from scriptorium.operators.lines import lines_of


def claim_language(docs: DataFrame, lexicon=CLAIM_LANGUAGE) -> DataFrame:
    """Matches in a stream of documents; stateless, so any output mode will do."""
    return matches(lines_of(docs), lexicon)


def append_to(found: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream finds; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def event_counts(events: DataFrame, lateness: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(window_start, event, n) of events(ts, event); events later than `lateness` are left out."""
    counts = events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "event", "n")


def _next(state: str, event: str) -> str:
    if event in ("verify", "fail"):
        return "verified" if event == "verify" else "regressed"
    if event == "start" and state in ("pending", "regressed"):
        return "in_progress"
    return "claimed" if event == "complete" and state == "in_progress" else state


class _InOrder(StatefulProcessor):
    """Holds a task's events until the watermark is past them, and then takes them by time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts timestamp, event_id long, event string")
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.held.appendList(list(batch[["ts", "event_id", "event"]].itertuples(index=False, name=None)))
            for ts in batch["ts"].drop_duplicates():
                # a timer of so many milliseconds is due once the watermark has passed them
                self.handle.registerTimer(_milliseconds(ts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.held.get())
        now = sorted((e for e in held if _milliseconds(e[0]) <= due), key=lambda e: (e[0], e[1]))
        if not now:
            return iter(())
        rest = [e for e in held if _milliseconds(e[0]) > due]
        self.held.put(rest) if rest else self.held.clear()
        state, out = self.state.get()[0] if self.state.exists() else "pending", []
        for ts, event_id, event in now:
            after = _next(state, event)
            if event in ("verify", "fail") or after != state:
                out.append((key[0], ts, event_id, event, after))
            state = after
        self.state.update((state,))
        return iter([pd.DataFrame(out, columns=["task_id", "ts", "event_id", "event", "to_state"])] if out else [])

    def close(self) -> None:
        pass


def _milliseconds(ts) -> int:
    """Rounded up, so that a timer is never due before its event."""
    return -(-pd.Timestamp(ts).value // 1_000_000)


def task_evidence(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(task_id, ts, event_id, event, to_state): the allowed events of a stream of events(task_id, ts, event_id, event), each once, to be appended.

    Events are held in the state store until the watermark, `lateness` behind
    the latest time seen, has passed them; so those that come late within it
    are taken in their place, as a batch over all events would. Later ones are
    left out. State lies in RocksDB, which the session has to name as its state
    store.
    """
    held = events.withWatermark("ts", lateness).groupBy("task_id")
    return held.transformWithStateInPandas(_InOrder(), "task_id long, ts timestamp, event_id long, event string, to_state string", "append", "EventTime")


def task_states(events: DataFrame) -> DataFrame:
    """(task_id, state) after each batch of events(task_id, ts, event_id, event), kept in the state store by task.

    Within a batch events are taken in order of time; what arrives in a later
    batch counts as later.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = kept.get[0] if kept.exists else "pending"
        for event in pd.concat(batches).sort_values(["ts", "event_id"])["event"]:
            state = _next(state, event)
        kept.update((state,))
        yield pd.DataFrame({"task_id": [key[0]], "state": [state]})

    return events.groupBy("task_id").applyInPandasWithState(fold, "task_id long, state string", "state string", "update", GroupStateTimeout.NoTimeout)
