"""Login lockout: a key's failures are counted in a fixed window that begins at the first of them; success clears them.

Over a table, events are dealt out by range of key and time, so that a key with very many events is many chunks. A chunk tells in
a table of fixed form what becomes of any state (count, window's end) that enters it: only events of its first window's length
matter. The tables of a key's chunks are applied in order, and every chunk then knows what it begins with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera import params as P
from tessera.scratch import Scratch

LOCKOUT = "email string, ip string, ts timestamp, success boolean, attempts int, locked boolean"
MICROS = P.LOCKOUT_MINUTES * 60_000_000
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


@dataclass(frozen=True)
class State:
    """Failures in a window that ends at ``ends`` (microseconds), which means nothing where there are none."""

    count: int = 0
    ends: int = 0


@dataclass
class Table:
    """What becomes of a state over some events: ``head`` are the times within a window's length of the first one.

    count[j], ends[j] is the state in the end of one that is empty before event j; cleared is that after the first success, which is event first_ok.
    """

    n: int
    first_ok: int
    head: np.ndarray
    count: np.ndarray
    ends: np.ndarray
    cleared: State

    def leave(self, state: State, attempts: int = P.LOCKOUT_ATTEMPTS) -> State:
        if not state.count:
            return State(int(self.count[0]), int(self.ends[0]))
        j = int(np.searchsorted(self.head, state.ends))  # the first event after the window
        over = j < self.n and State(int(self.count[j]), int(self.ends[j]))
        if state.count + min(self.first_ok, j) >= attempts:
            return over or State(attempts, state.ends)
        if self.first_ok < j:
            return self.cleared
        return over or State(state.count + self.n, state.ends)


class Events:
    """A key's events in order: times in microseconds and whether they succeeded.

    An event at which the count is 0 opens a window, or is a success. What follows until the count is 0 again depends on it alone,
    so each event points to the one where that is; the events that are reached from the first one split the rest.
    """

    def __init__(self, us: np.ndarray, ok: np.ndarray, attempts: int = P.LOCKOUT_ATTEMPTS, micros: int = MICROS):
        self.us, self.ok, self.attempts, self.micros, n = us, ok, attempts, micros, len(us)
        at = np.arange(n)
        after = np.searchsorted(us, us + micros)
        good = np.append(np.flatnonzero(ok), n)
        self.next_ok = good[np.searchsorted(good, at)]
        self.fails = np.minimum(self.next_ok, after) - at
        self.locks = self.fails >= attempts
        by_time = self.locks | (self.next_ok >= after)
        self.back = np.where(by_time, after, self.next_ok + 1)
        self.open = by_time & (after == n)  # its window is not over when the events are

    def table(self) -> Table:
        n = len(self.us)
        last = np.where(self.back < n, self.back, np.arange(n))
        while True:  # to the last event that opens a window, in steps that double
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        count = np.where(self.open[last], np.minimum(self.fails[last], self.attempts), 0)
        ends = np.where(self.open[last], self.us[last] + self.micros, 0)
        head = int(np.searchsorted(self.us, self.us[0] + self.micros))
        first = int(self.next_ok[0])
        cleared = State(int(count[first + 1]), int(ends[first + 1])) if first + 1 < n else State()
        return Table(n, first, self.us[:head], count[: head + 1], ends[: head + 1], cleared)

    def outcomes(self, state: State) -> tuple[np.ndarray, np.ndarray, State]:
        """Failures counted after each event, whether the key was locked when it came, and the state in the end."""
        n, a = len(self.us), self.attempts
        attempts, locked, begin = np.zeros(n, np.int32), np.zeros(n, bool), 0
        if state.count and n:
            j, first = int(np.searchsorted(self.us, state.ends)), int(self.next_ok[0])
            shut = state.count + min(first, j) >= a
            begin = j if shut or first >= j else first + 1
            counted = state.count + 1 + np.arange(begin)
            attempts[:begin] = np.minimum(counted, a)
            if shut:
                locked[:begin] = counted > a
            elif first < j:
                attempts[first] = 0
            if begin == n:
                state = State() if not shut and first < j else State(min(state.count + n, a), state.ends)
        starts, at = [], begin
        while at < n:
            starts.append(at)
            at = int(self.back[at])
        if starts:
            root = np.repeat(starts, np.diff([*starts, n]))
            k = np.arange(begin, n) - root
            shut = self.locks[root]
            attempts[begin:] = np.where(shut, np.minimum(k + 1, a), np.where(self.ok[begin:], 0, k + 1))
            locked[begin:] = shut & (k >= a)
            last = starts[-1]
            state = State(int(min(self.fails[last], a)), int(self.us[last]) + self.micros) if self.open[last] else State()
        return attempts, locked, state


def micros_of(ts: Column, kind: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone; no session's zone matters."""
    if kind != "timestamp_ntz":
        return F.unix_micros(ts)
    part = lambda unit: F.extract(F.lit(unit), ts - F.expr(_EPOCH))
    minutes = (part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def _time_of(us: Column, kind: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, us, {_EPOCH})") if kind == "timestamp_ntz" else F.timestamp_micros(us)


_CHUNK = "email string, ip string, pid int, seq long, open boolean, us array<long>, ok array<boolean>"
_TABLE = "email string, ip string, pid int, seq long, n long, first_ok long, head array<long>, count array<long>, ends array<long>, cleared_count long, cleared_ends long"


def _chunks(most: int):
    """Events in order of key and time as chunks of one key, at most ``most`` each. The first and the last key of a partition, and those with
    several chunks, are open: others of their chunks may stand elsewhere."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.bool_()))
    names = [c.split()[0] for c in _CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seq, out, held = TaskContext.get().partitionId(), 0, [], 0
        key, parts, size, open_ = None, [], 0, True

        def close(last: bool) -> None:
            nonlocal parts, size, seq, held
            out.append((*key, pid, seq, open_ or last, np.concatenate([u for u, _ in parts]), np.concatenate([o for _, o in parts])))
            held += size
            seq, parts, size = seq + 1, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)
            out, held = [], 0
            return batch

        for b in batches:
            if not b.num_rows:
                continue
            email, ip = (np.array(b.column(i).to_pylist(), object) for i in (0, 1))
            us, ok = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((email[1:] != email[:-1]) | (ip[1:] != ip[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
                if key is not None and (email[lo], ip[lo]) != key:
                    close(False)
                    open_ = False
                key = (email[lo], ip[lo])
                while lo < hi:
                    step = min(hi - lo, most - size)
                    parts.append((us[lo : lo + step], ok[lo : lo + step]))
                    size, lo = size + step, lo + step
                    if size == most and lo < hi:
                        open_ = True
                        close(True)
                if size == most:
                    open_ = True
                if held >= 4 * most:
                    yield flush()
        if size:
            close(True)
        if out:
            yield flush()

    return run


def _tables(attempts: int, micros: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                t = Events(np.array(row["us"], np.int64), np.array(row["ok"], bool), attempts, micros).table()
                values = (row["email"], row["ip"], row["pid"], row["seq"], t.n, t.first_ok, t.head, t.count, t.ends, t.cleared.count, t.cleared.ends)
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in _TABLE.split(", ")])

    return run


def _entries(attempts: int):
    """The state that each chunk begins with, over the tables of whole keys in order; one table is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, State()
        for b in batches:
            out = []
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if (row["email"], row["ip"]) != key:
                    key, state = (row["email"], row["ip"]), State()
                out.append((row["pid"], row["seq"], state.count, state.ends))
                arrays = (np.array(row[c], np.int64) for c in ("head", "count", "ends"))
                state = Table(row["n"], row["first_ok"], *arrays, State(row["cleared_count"], row["cleared_ends"])).leave(state, attempts)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["pid", "seq", "count", "ends"])

    return run


def _outcomes(attempts: int, micros: int):
    names = ["email", "ip", "us", "ok", "attempts", "locked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                us, ok = np.array(row["us"], np.int64), np.array(row["ok"], bool)
                n, locked, _ = Events(us, ok, attempts, micros).outcomes(State(row["count"], row["ends"]))
                same = lambda v: pa.array([v] * len(us), pa.string())
                yield pa.RecordBatch.from_arrays([same(row["email"]), same(row["ip"]), pa.array(us), pa.array(ok), pa.array(n), pa.array(locked)], names=names)

    return run


def lockout_batch(events: DataFrame, *, attempts: int = P.LOCKOUT_ATTEMPTS, minutes: int = P.LOCKOUT_MINUTES, chunk: int = 50_000) -> DataFrame:
    """Every event of (email, ip, ts, success) with the key's failures after it (``attempts``) and whether the key was locked when it came (``locked``).

    ts may be a timestamp with or without a time zone and comes out as it came in. Of events of one time failures come first. A null success is a
    failure and comes out as one; null emails and addresses are keys as others; events without a time have neither attempts nor locked. Repeated
    rows are events of their own, other columns are ignored, an empty table gives no rows.

    Events are dealt out by range of (email, ip, time), so a key of any size is spread evenly; chunks have at most ``chunk`` events. What passes
    through one task for a key is one table a chunk, of the events in its first window.
    """
    kind = dict(events.dtypes)["ts"]
    micros = minutes * 60_000_000
    scratch = Scratch(events.sparkSession, "lockout")
    ok = F.coalesce(F.col("success").cast("boolean"), F.lit(False)).alias("ok")
    rows = events.select(F.col("email").cast("string").alias("email"), F.col("ip").cast("string").alias("ip"), micros_of(F.col("ts"), kind).alias("us"), ok)
    order = ["email", "ip", "us", "ok"]
    dealt = rows.where("us is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = scratch.save(dealt.mapInArrow(_chunks(chunk), _CHUNK))
    tables = chunks.where("open").mapInArrow(_tables(attempts, micros), _TABLE)
    entries = tables.repartition("email", "ip").sortWithinPartitions("email", "ip", "pid", "seq").mapInArrow(_entries(attempts), "pid int, seq long, count int, ends long")
    columns = ["email", "ip", "us", "ok"]
    none = [F.lit(0).alias("count"), F.lit(0).cast("long").alias("ends")]
    both = chunks.where("not open").select(*columns, *none).unionByName(chunks.where("open").join(entries, ["pid", "seq"]).select(*columns, "count", "ends"))
    found = both.mapInArrow(_outcomes(attempts, micros), "email string, ip string, us long, ok boolean, attempts int, locked boolean")
    timeless = rows.where("us is null").select(*columns, F.lit(None).cast("int").alias("attempts"), F.lit(None).cast("boolean").alias("locked"))
    out = found.unionByName(timeless)
    return out.select("email", "ip", _time_of(F.col("us"), kind).alias("ts"), F.col("ok").alias("success"), "attempts", "locked")


class LockoutProcessor(StatefulProcessor):
    """The same over a stream: the state of a key is its count and its window's end in event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lockout", "count int, ends long")  # microseconds
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        state = State(old[0], old[1]) if old else State()
        pdf = pd.concat(list(rows)).sort_values(["us", "success"], kind="stable")
        attempts, locked, state = Events(pdf["us"].to_numpy(), pdf["success"].to_numpy().astype(bool)).outcomes(state)
        yield pdf.assign(attempts=attempts, locked=locked)[["email", "ip", "ts", "success", "attempts", "locked"]]
        if state.count:
            self.state.update((state.count, state.ends))
            self.handle.registerTimer(state.ends // 1000 + 1)
        elif self.state.exists():
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Drops a window that has ended by event time; a newer one has a timer of its own."""
        if self.state.exists():
            if self.state.get()[1] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
                self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def lockout_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Needs the RocksDB state store provider. Times without a zone are taken as UTC; events without a time are left to the batch."""
    kind = dict(events.dtypes)["ts"]
    us = micros_of(F.col("ts"), kind)
    rows = events.select("email", "ip", us.alias("us"), F.coalesce("success", F.lit(False)).alias("success")).where("us is not null")
    rows = rows.select("email", "ip", F.timestamp_micros("us").alias("ts"), "success", "us")
    return rows.withWatermark("ts", late).groupBy("email", "ip").transformWithStateInPandas(LockoutProcessor(), outputStructType=LOCKOUT, outputMode="Append", timeMode="EventTime")
