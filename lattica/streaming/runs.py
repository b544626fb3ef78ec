"""Learning curves out of the event lines of evaluation runs, as a batch and as a stream.

A run's text comes in numbered chunks that may end within a line. A start event names the
run's task, models and labelled pixels; each progress event then has scores of some of its
models, which become points of their curves. The same small reader serves both forms.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

POINT = "model string, pct double, x double, mean double, low double, high double"


class RunReader:
    """What a run has said so far: its last start, and the part of a line that is not whole yet."""

    def __init__(self, rest: str = "", following: int = 0, start: str = ""):
        self.rest, self.following, self.start = rest, following, start
        self.known = json.loads(start) if start else None

    def feed(self, seq: int, chunk: str) -> list[tuple]:
        """Points of the lines that this chunk completes; a chunk that has been read already says nothing."""
        if seq < self.following:
            return []
        self.following = seq + 1
        *lines, self.rest = (self.rest + chunk).split("\n")
        return [point for line in lines for point in self.line(line)]

    def line(self, line: str) -> list[tuple]:
        """Points of one line; heartbeats, other events and what is no JSON object have none."""
        try:
            event = json.loads(line)
        except ValueError:
            return []
        if not isinstance(event, dict):
            return []
        scores = event.get("classifiers")
        if event.get("event") == "start" and isinstance(scores, list):
            self.known = {"task": event.get("task"), "total": event.get("total_labelled_pixels") or 1, "models": scores}
            self.start = json.dumps(self.known)
        if event.get("event") != "progress" or not isinstance(scores, dict) or not self.known:
            return []
        out = []
        for model, score in scores.items():
            if model not in self.known["models"]:
                continue
            train = event.get("unet_train_count" if model == "unet" else "pixel_train_count")
            regression = self.known["task"] == "regression"
            mean, std = (score.get(f"{x}_{'r2' if regression else 'f1'}") for x in ("mean", "std"))
            if mean is None or train is None:
                continue
            low, high = mean - (std or 0.0), mean + (std or 0.0)
            bounded = (low, high) if regression else (max(0.0, low), min(1.0, high))  # an R2 may be negative
            out.append((model, float(event.get("pct") or 0), train / self.known["total"] * 100, float(mean), *map(float, bounded)))
        return out


def curve_points(chunks: DataFrame, run: str, seq: str, text: str) -> DataFrame:
    """Points of all runs (run, model, pct, x, mean, low, high) from their chunks, numbered from 0.

    Rows pass sorted by run and number; a run's state is its start and one part of a
    line. What follows a missing chunk is not read; a null chunk is empty.
    """
    rows = chunks.select(F.col(run).alias("run"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.where("run is not null").repartition("run").sortWithinPartitions("run", "seq")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, reader = None, RunReader()
        for batch in batches:
            found = []
            for name, at, chunk in zip(batch["run"], batch["seq"], batch["text"], strict=True):
                if name != current:
                    current, reader = name, RunReader()
                if at <= reader.following:
                    found += [(name, *p) for p in reader.feed(at, chunk)]
            yield _points(found)

    return dealt.mapInPandas(read, f"run {dict(rows.dtypes)['run']}, {POINT}").withColumnRenamed("run", run)


class _Curves(StatefulProcessor):
    """State of a run: the reader's fields as a value, chunks that came before their turn as a list, and a timer."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reader = handle.getValueState("reader", "rest string, following long, start string, seen long")
        self.early = handle.getListState("early", "seq long, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rest, following, start, _ = self.reader.get() if self.reader.exists() else ("", 0, "", 0)
        reader = RunReader(rest, following, start)
        waiting = {int(s): t for s, t in self.early.get()} if self.early.exists() else {}
        for batch in rows:
            waiting |= {int(s): t for s, t in zip(batch["seq"], batch["text"], strict=True) if s >= following}
        found = []
        while reader.following in waiting:
            at = reader.following
            found += [(key[0], *p) for p in reader.feed(at, waiting.pop(at))]
        now = timerValues.getCurrentProcessingTimeInMs()
        self.reader.update((reader.rest, reader.following, reader.start, now))
        self.early.clear()
        if waiting:
            self.early.put(sorted(waiting.items()))
        self.handle.registerTimer(now + self.idle)
        yield _points(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # an older timer than the run's last rows says nothing
        if self.reader.exists() and self.reader.get()[3] + self.idle <= expiredTimerInfo.getExpiryTimeInMs():
            self.reader.clear()
            self.early.clear()
        yield _points([])

    def close(self) -> None:
        pass


def _points(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["run", *(x.split()[0] for x in POINT.split(", "))])


def stream_curve_points(chunks: DataFrame, run: str, seq: str, text: str, idle: int = 3_600_000) -> DataFrame:
    """curve_points() over a stream: chunks may come late, early or twice.

    A run's state goes when nothing has come for ``idle`` milliseconds. The session's state
    store has to be RocksDB's. As long as timers wait, Spark goes on with empty batches, so
    that a query ends by stop() and not by a trigger.
    """
    rows = chunks.select(F.col(run).cast("string").alias("run"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.where("run is not null").groupBy("run").transformWithStateInPandas(_Curves(idle), f"run string, {POINT}", "append", "processingTime")
    return out.withColumnRenamed("run", run)
