"""Event lines, their latest states, and a sliding-window limiter; as batches and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "event string, model string, pct double, score double, message string"
#: Attempts let through in a window, and the window's seconds.
MOST, WINDOW_SECONDS = 5, 600


def parse_lines(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    """JSON objects of lines ``value``; lines that are not, empty ones and heartbeats are skipped."""
    text = lines.where(F.trim("value") != "")
    parsed = text.withColumn("e", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("e is not null and e._bad is null and e.event is not null and e.event <> 'heartbeat'").select("e.*").drop("_bad")


def stream_lines(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """parse_lines() over a folder that grows."""
    return parse_lines(spark.readStream.text(path), schema)


def score_table(events: DataFrame, models: list[str]) -> DataFrame:
    """The last score of each model at each share of the training rows."""
    return events.where("event = 'progress'").groupBy("pct").pivot("model", models).agg(F.max("score"))


def latest(log: DataFrame, key: str, time: str) -> DataFrame:
    """The last row of each key."""
    rest = [x for x in log.columns if x not in (key, time)]
    return log.groupBy(key).agg(F.max(time).alias(time), F.max_by(F.struct(*rest), F.struct(time, *rest)).alias("s")).select(key, time, "s.*")


def edges(log: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """Rows at which a boolean state changes; before its first row it is false."""
    before = F.lag(state, 1, False).over(Window.partitionBy(key).orderBy(time))
    return log.withColumn("before", before).where(F.col("before") != F.col(state)).drop("before")


def attempts_in_window(log: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Adds ``attempts``: rows of the key in the window that ends here, this one included."""
    window = Window.partitionBy(key).orderBy("__at").rangeBetween(1 - 1_000_000 * seconds, 0)
    return log.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("attempts", F.count(F.lit(1)).over(window)).drop("__at")


def admitted(times: list[float], held: list[float], most: int, seconds: float) -> tuple[list[bool], list[int], list[float]]:
    """Which attempts, in order, are let through, after how many seconds to try again, and the times that still count."""
    none = [None] * len(times)
    passed, retry, left = settled(times, none, none, [(t, None) for t in held], most, seconds)
    return passed, retry, [t for t, _ in left]


Slot = tuple[float, str | None]


def settled(
    times: list[float], ids: list[str | None], frees: list[str | None], held: list[Slot], most: int, seconds: float
) -> tuple[list[bool], list[int], list[Slot]]:
    """What the rows of one key, in order, meet with.

    An attempt takes a slot if fewer than ``most`` are held, else it hears after how many
    seconds to try again. A row that ``frees`` an attempt gives its slot back, if that
    attempt was let through and still counts; for such a row the answer is whether it did.
    """
    passed, retry = [], []
    for now, own, freed in zip(times, ids, frees, strict=True):
        held = [x for x in held if now - x[0] < seconds]
        wait = 0
        if freed is not None:
            left = [x for x in held if x[1] != freed]
            ok, held = len(left) < len(held), left
        elif ok := len(held) < most:
            held.append((now, own))
        else:
            wait = max(1, int(seconds - (now - held[0][0])))
        passed.append(ok)
        retry.append(wait)
    return passed, retry, held


def outcomes(attempts: DataFrame, key: str, time: str, order: str, ended: str, given_back: Column) -> DataFrame:
    """Attempts and the failures that give them back, as rows of one log: ``key``, at, row, frees.

    A row is named by ``order`` with ``+`` for an attempt and ``-`` for its failure, which
    stands at the time ``ended``. Failures are those rows for which ``given_back`` holds;
    others, as a place without data or a bad request, keep their slot.
    """
    name = F.col(order).cast("string")
    start = F.struct(F.col(time).alias("at"), F.concat(F.lit("+"), name).alias("row"), F.lit(None).cast("string").alias("frees"))
    end = F.struct(F.col(ended).alias("at"), F.concat(F.lit("-"), name).alias("row"), F.concat(F.lit("+"), name).alias("frees"))
    return attempts.select(key, F.inline(F.when(given_back, F.array(start, end)).otherwise(F.array(start))))


def rate_release(log: DataFrame, key: str, time: str, order: str, frees: str, most: int = MOST, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """rate_limit() over a log in which later rows can give an attempt's slot back.

    Rows are attempts, or have the ``order`` of an attempt of the same key in ``frees``.
    Adds allowed (for a release: whether it freed a slot) and retry_after. Rows pass
    sorted by key, time and order; a key's state is its slots, ``most`` at most.
    """
    rows = log.select(F.col(key).alias("k"), F.col(time).cast("timestamp").cast("double").alias("at"), F.col(order).cast("string").alias("o"), F.col(frees).cast("string").alias("f"))
    dealt = rows.repartition("k").sortWithinPartitions("k", "at", "o")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for batch in batches:
            allowed, retry = [], []
            for k, group in batch.groupby("k", sort=False, dropna=False):
                if k != current and not (pd.isna(k) and pd.isna(current)):
                    current, held = k, []
                ok, wait, held = settled(group["at"].tolist(), group["o"].tolist(), _texts(group["f"]), held, most, seconds)
                allowed += ok
                retry += wait
            yield batch.assign(allowed=allowed, retry_after=retry)

    out = dealt.mapInPandas(run, f"k {dict(rows.dtypes)['k']}, at double, o string, f string, allowed boolean, retry_after long")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), F.col("f").alias(frees), "allowed", "retry_after")


def _texts(column: pd.Series) -> list[str | None]:
    return [None if pd.isna(x) else x for x in column]


def stream_rate_release(log: DataFrame, key: str, time: str, order: str, frees: str, most: int = MOST, seconds: float = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """rate_release() over a stream, per micro-batch in the order of time and row.

    A key's state is its slots, with the time and the row that took each. A timer drops it
    once the watermark has passed the last slot by a window.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = log.withWatermark(time, late).select(F.col(key).cast("string").alias("k"), F.col(time).alias("ts"), F.col(order).cast("string").alias("o"), F.col(frees).cast("string").alias("f"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        group = pd.concat(list(batches)).sort_values(["ts", "o"])  # one key's rows of one micro-batch
        at = (group["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        ok, wait, held = settled(at, group["o"].tolist(), _texts(group["f"]), held, most, seconds)
        if held:
            state.update(([t for t, _ in held], [x for _, x in held]))
            state.setTimeoutTimestamp(max(int((held[-1][0] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"k": k[0], "ts": group["ts"], "o": group["o"], "allowed": ok, "retry_after": wait})

    return rows.groupBy("k").applyInPandasWithState(
        run, "k string, ts timestamp, o string, allowed boolean, retry_after long", "at array<double>, rows array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def rate_limit(log: DataFrame, key: str, time: str, order: str, most: int = MOST, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Adds allowed and retry_after to rows (key, time, order); rejected attempts do not count against later ones.

    A key's state is its last ``most`` admitted times: rows are shuffled and sorted by
    key and time, and pass as a stream, so that no key is held as a whole.
    """
    rows = log.select(F.col(key).alias("k"), F.col(time).cast("timestamp").cast("double").alias("at"), F.col(order).alias("o"))
    dealt = rows.repartition("k").sortWithinPartitions("k", "at", "o")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for batch in batches:
            allowed, retry = [], []
            for k, group in batch.groupby("k", sort=False, dropna=False):
                if k != current and not (pd.isna(k) and pd.isna(current)):
                    current, held = k, []
                ok, wait, held = admitted(group["at"].tolist(), held, most, seconds)
                allowed += ok
                retry += wait
            yield batch.assign(allowed=allowed, retry_after=retry)

    kinds = dict(rows.dtypes)
    out = dealt.mapInPandas(run, f"k {kinds['k']}, at double, o {kinds['o']}, allowed boolean, retry_after long")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), "allowed", "retry_after")


def stream_rate_limit(log: DataFrame, key: str, time: str, most: int = MOST, seconds: float = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The limiter over a stream: per micro-batch in the order of time, with each key's admitted times as state.

    State is dropped once the watermark has passed a key's last admitted time by a window.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = log.withWatermark(time, late).select(F.col(key).cast("string").alias("k"), F.col(time).alias("ts"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        group = pd.concat(list(batches)).sort_values("ts")  # one key's rows of one micro-batch
        at = (group["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        ok, wait, held = admitted(at, held, most, seconds)
        if held:
            state.update((held,))
            state.setTimeoutTimestamp(max(int((held[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": k[0], "ts": group["ts"], "allowed": ok, "retry_after": wait})

    return rows.groupBy("k").applyInPandasWithState(
        run, "k string, ts timestamp, allowed boolean, retry_after long", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )
