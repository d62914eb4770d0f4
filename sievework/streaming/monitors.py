"""Stateful stream monitors (ST4, ST5).

Rows of a key wait in state until the watermark has passed the end of their time slice; the key's event-time
timer then hands all complete slices over in time order. So results don't depend on how rows fall into
micro-batches, no frame is larger than an Arrow batch or ``SLICES`` slices of one key, and a key without rows for
``idle`` leaves the state. Rows without a time, and rows of a slice that is already settled, are left out.
Both monitors need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Slices whose rows wait together; all rows of a key in so many slices are in memory at once.
SLICES = 16


class InTimeOrder(StatefulProcessor):
    """Settles the rows of a key slice by slice; ``step`` and ``forget`` say what a monitor does with them.

    State: the waiting rows by span of ``SLICES`` slices and part, an entry for each Arrow batch; the spans with their
    parts and the end of their first open slice, and the key's one timer; the end of the last settled slice. So the calls to
    the state grow with the spans of a key and not with its slices. A row later than ``idle`` after the last settled slice
    finds a key that has been forgotten, whether its timer has run or not.
    """

    kind: str  # type of the column that is watched
    column: str

    def __init__(self, slice_ms: int, idle_ms: int) -> None:
        self.slice_ms = slice_ms
        self.idle_ms = -(-idle_ms // slice_ms) * slice_ms  # whole slices

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "span long, part long", f"at array<long>, tie array<long>, x array<{self.kind}>")
        self.spans = handle.getValueState("spans", "span array<long>, parts array<long>, opens array<long>, due long")
        self.settled = handle.getValueState("settled", "ends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held, due = self._held()
        new = False
        for frame in rows:
            frame = frame.dropna(subset=["at"])
            number = frame["at"].astype("int64") // (self.slice_ms * 1000)
            there = (number + 1) * self.slice_ms > passed
            frame, number = frame[there], number[there]
            for span, part in frame.groupby(number // SLICES):
                span, opens = int(span), (int(number[part.index].min()) + 1) * self.slice_ms
                parts, before = held.get(span, (0, opens))
                self.rows.updateValue((span, parts), ([int(v) for v in part["at"]], _plain(part["order"], int), _plain(part[self.column], self.cast)))
                held[span] = (parts + 1, min(before, opens))
                new = True
        if new:
            first = min(opens for _, opens in held.values())
            if due is None or first < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(first)
                due = first
            self._hold(held, due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held, _ = self._held()
        found = self.settled.get()
        last = found[0] if found else None
        for span in sorted(held):
            parts, opens = held[span]
            if opens > passed:
                continue
            waiting = []
            for part in range(parts):
                waiting += zip(*self.rows.getValue((span, part)))
                self.rows.removeKey((span, part))
            waiting.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, str(r[2])))
            run, rest = [], []
            for row in waiting:
                ends = self._ends(row[0])
                if ends > passed:
                    rest.append(row)
                    continue
                if last is not None and ends - last > self.idle_ms:
                    yield from self._settle(key, run)
                    self.forget()
                    run = []
                run.append(row)
                last = ends
            yield from self._settle(key, run)
            del held[span]
            if rest:
                self.rows.updateValue((span, 0), tuple(list(column) for column in zip(*rest)))
                held[span] = (1, self._ends(rest[0][0]))
        if last is not None and passed > last + self.idle_ms:
            self.forget()
            self.settled.clear()
            last = None
        elif last is not None:
            self.settled.update((last,))
        ahead = [opens for _, opens in held.values()] + ([] if last is None else [last + self.idle_ms + 1])
        if ahead:
            self.handle.registerTimer(min(ahead))
            self._hold(held, min(ahead))
        else:
            self.spans.clear()

    def _ends(self, at: int) -> int:
        return (at // (self.slice_ms * 1000) + 1) * self.slice_ms

    def _held(self) -> tuple[dict, int | None]:
        found = self.spans.get()
        return ({s: (p, o) for s, p, o in zip(*found[:3])}, found[3]) if found else ({}, None)

    def _hold(self, held: dict, due: int) -> None:
        self.spans.update((list(held), [p for p, _ in held.values()], [o for _, o in held.values()], due))

    def _settle(self, key, run: list) -> Iterator[pd.DataFrame]:
        if run:
            out = self.step(key, [r[0] for r in run], [r[2] for r in run])
            if len(out):
                yield out

    def close(self) -> None:
        pass


def _plain(values: pd.Series, cast) -> list:
    return [None if pd.isna(v) else cast(v) for v in values]


class RollingMean(InTimeOrder):
    """Mean of the last five samples of (host, metric), once there are more than five; nulls count as samples only.

    State besides the waiting rows: the last four values and a count.
    """

    kind, column, cast = "double", "value", float

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tail = handle.getValueState("tail", "last array<double>, seen long")

    def step(self, key, at: list, values: list) -> pd.DataFrame:
        tail, seen = self.tail.get() if self.tail.exists() else ([], 0)
        means = []
        for value in values:
            seen += 1
            tail = [*tail, value][-5:]
            known = [v for v in tail if v is not None]
            means.append(sum(known) / len(known) if seen > 5 and known else None)
        self.tail.update((tail[-4:], seen))
        return pd.DataFrame(
            {"host": key[0], "metric": key[1], "at": at, "value": pd.Series(values, dtype="float64"), "rolling": pd.Series(means, dtype="float64")}
        )

    def forget(self) -> None:
        self.tail.clear()


class PhaseTracker(InTimeOrder):
    """One row per finished phase of a run; a repeat of the current phase, or a row without one, changes nothing.

    A run without rows for ``idle`` is over: its last phase has no end, and a later row starts anew.
    """

    kind, column, cast = "string", "phase", str

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.current = handle.getValueState("current", "phase string, since long")

    def step(self, key, at: list, phases: list) -> pd.DataFrame:
        phase, since = self.current.get() if self.current.exists() else (None, None)
        out = []
        for now, new in zip(at, phases):
            if new is None or new == phase:
                continue
            if phase is not None:
                out.append((key[0], phase, since, (now - since) / 1e6))
            phase, since = new, now
        if phase is not None:
            self.current.update((phase, since))
        return pd.DataFrame(out, columns=["run", "phase", "at", "seconds"])

    def forget(self) -> None:
        self.current.clear()


def _milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def _settled(stream: DataFrame, keys: list[str], processor: type[InTimeOrder], schema: str, late: str, span: str, idle: str) -> DataFrame:
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select(*keys, "ts", F.unix_micros("ts").alias("at"), F.col("order").cast("long").alias("order"), F.col(processor.column).cast(processor.kind))
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor(_milliseconds(span), _milliseconds(idle)), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def rolling_monitor(stream: DataFrame, late: str = "1 hour", span: str = "1 day", idle: str = "30 days") -> DataFrame:
    """ST4: ``stream(host, metric, ts, order, value)``; rows come out once the slice (``span``) they lie in is complete.

    A (host, metric) without rows for ``idle`` starts anew.
    """
    out = _settled(stream, ["host", "metric"], RollingMean, "host string, metric string, at long, value double, rolling double", late, span, idle)
    return out.select("host", "metric", F.timestamp_micros("at").alias("ts"), "value", "rolling")


def phase_monitor(stream: DataFrame, late: str = "1 hour", span: str = "1 day", idle: str = "30 days") -> DataFrame:
    """ST5: ``stream(run, ts, order, phase)``; a phase comes out with the slice that holds its end."""
    out = _settled(stream, ["run"], PhaseTracker, "run string, phase string, at long, seconds double", late, span, idle)
    return out.select("run", "phase", F.timestamp_micros("at").alias("since"), "seconds")
