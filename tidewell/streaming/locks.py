"""Streaming forms that keep state for each key: failure locks, and sessions that end when idle."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: State stores with lists and timers need this provider; a stream that has begun keeps its own.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Attempts of one key and batch that a task sorts in memory, and rows that it gives out at once.
SORTED, GIVEN = 1 << 18, 10_000
EVENT = np.dtype([("us", "<i8"), ("rank", "<i8"), ("bad", "?")])


def by_time(frames: Iterable[pd.DataFrame], most: int = SORTED) -> Iterator[tuple[int, int, bool]]:
    """(us, rank, bad) of all frames by time, then rank; beyond ``most`` rows by sorted runs in a file of the task."""

    def run(frames: list[pd.DataFrame]) -> np.ndarray:
        out = np.empty(sum(map(len, frames)), EVENT)
        for name in EVENT.names:
            out[name] = np.concatenate([f[name].to_numpy() for f in frames])
        return out[np.lexsort((out["rank"], out["us"]))]

    with tempfile.TemporaryFile() as file:
        held, ends = [], [0]
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= most:
                file.write(run(held).tobytes())
                held = []
                ends.append(file.tell())
        if len(ends) == 1:
            yield from run(held).tolist() if held else ()
            return
        if held:
            file.write(run(held).tobytes())
            ends.append(file.tell())
        block = max(most // len(ends), 256) * EVENT.itemsize

        def read(start: int, stop: int) -> Iterator[tuple[int, int, bool]]:
            while start < stop:
                file.seek(start)
                data = file.read(min(block, stop - start))
                start += len(data)
                yield from np.frombuffer(data, EVENT).tolist()

        yield from heapq.merge(*map(read, ends, ends[1:]))


class Locks(StatefulProcessor):
    """The recorded failures of a key, at most ``most`` instants, and a timer for when the last of them is too old."""

    def __init__(self, keys: list[str], most: int, span: int, held: int):
        self.keys, self.most, self.span, self.held = keys, most, span, held

    def init(self, handle) -> None:
        self.handle = handle
        self.failures = handle.getListState("fallos", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recorded, out = [us for (us,) in self.failures.get()], []
        for at, _, bad in by_time(rows, self.held):
            recorded = [t for t in recorded if at - t < self.span]
            locked = len(recorded) >= self.most
            wait = (self.span - (at - recorded[0])) // 1_000_000 + 1 if locked else 0
            out.append((*key, at, bad, locked, wait))
            if not locked:
                recorded = [*recorded, at] if bad else []
            if len(out) == GIVEN:
                yield self.frame(out)
                out = []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if recorded:
            self.failures.put([(us,) for us in recorded])
            self.handle.registerTimer(max(-(-(recorded[-1] + self.span) // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.failures.clear()
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.failures.clear()
        yield from ()

    def close(self) -> None:
        pass

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*self.keys, "us", "fallo", "bloqueado", "espera"])


def failure_locks(stream: DataFrame, keys: list[str], ts: str, failed: Column, most: int = 5, window: int = 300, delay: str = "1 minute", order: Column | None = None, held: int = SORTED) -> DataFrame:
    """(keys, ts, fallo, bloqueado, espera) of each attempt, by its key's recorded failures.

    A key with ``most`` failures in the last ``window`` seconds is locked: attempts are refused, with the seconds
    to wait, and not recorded.  A success clears the record.  Attempts of a batch are taken by their time, then by
    ``order``, a whole number (without it, ties as they come).  The state of a key is a list of at most ``most``
    instants and goes by a timer when the watermark has passed the window of the last; a task holds ``held`` attempts
    of a key at once and merges more from sorted runs.  A null ``failed`` is no failure; attempts without a time are
    left out, and those behind the watermark too.  Sets the state store provider of the session to RocksDB.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = dict(stream.dtypes)
    named = [f"k{i}" for i in range(len(keys))]  # as keys may be called like the columns here
    timed = stream.withWatermark(ts, delay).where(F.col(ts).isNotNull())
    rank = (F.lit(0) if order is None else F.coalesce(order.cast("long"), F.lit(0))).alias("rank")
    told = timed.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col(ts).alias("t"), F.unix_micros(F.col(ts)).alias("us"), rank, F.coalesce(failed, F.lit(False)).alias("bad"))
    schema = ", ".join(f"{n} {kinds[k]}" for k, n in zip(keys, named, strict=True)) + ", us long, fallo boolean, bloqueado boolean, espera long"
    out = told.groupBy(*named).transformWithStateInPandas(Locks(named, most, window * 1_000_000, held), schema, "Append", "EventTime")
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, named, strict=True)), F.timestamp_micros("us").alias("ts"), "fallo", "bloqueado", "espera")


def recent(stream: DataFrame, ts: str, now, hours: int) -> DataFrame:
    """Rows without a date, or not older than so many hours; no hours: all rows."""
    return stream.where(F.col(ts).isNull() | (F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS"))) if hours else stream


def sessions(stream: DataFrame, keys: list[str], ts: str, idle: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """(keys, inicio, fin, eventos) of sessions that end ``idle`` after their last event."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, idle).alias("s"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("eventos")).select(*keys, F.col("s.start").alias("inicio"), F.col("s.end").alias("fin"), "eventos")
