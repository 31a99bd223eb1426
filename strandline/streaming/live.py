"""Streams with state: sentences paired within windows, sessions with timers, assembly, several sinks.

Sessions are keyed state of transformWithStateInPandas, which needs the RocksDB state store (see stored()).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from strandline.sources.folders import scratch

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stored(spark: SparkSession) -> SparkSession:
    """The session with RocksDB as its streams' state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return spark


def replayed(rows: DataFrame, ts: str, start: Callable[[DataFrame, str], StreamingQuery], steps: int = 3, mark: DataFrame | None = None) -> list[StreamingQuery]:
    """Plays a table as a stream: `steps` ranges of its times arrive one after another, and after each the
    stream runs over what has come, from its checkpoint, and stops. mark: rows that come last, to move the
    watermark on. start: of the stream and its checkpoint folder, the running query."""
    spark = stored(rows.sparkSession)
    folder, checkpoint = scratch(spark, "arrivals"), scratch(spark, "stream")
    low, high = rows.agg(F.min(ts).cast("double"), F.max(ts).cast("double")).first()
    part = F.least(F.lit(steps - 1), F.floor((F.col(ts).cast("double") - (low or 0)) / max((high or 0) - (low or 0), 1e-6) * steps))
    slices = [rows.filter(part == k) for k in range(steps)] + ([mark] if mark is not None else [])
    ran = []
    for one in slices:
        one.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        ran.append(start(stream, checkpoint))
        ran[-1].awaitTermination()
    return ran


def to_table(path: str) -> Callable[[DataFrame, str], StreamingQuery]:
    """For replayed(): appends a stream's rows to a Parquet table, each once."""
    return lambda rows, checkpoint: rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Sessions share keyed state by a hash, so that a state of many of them is read and written at once.
BUCKETS = 1024


def _bucket():
    return F.pmod(F.xxhash64("session"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _bucketed(events: DataFrame):
    return events.withColumn("bucket", _bucket()).groupBy("bucket")


def paired(events: DataFrame, bound: str = "1 hour", late: str = "10 minutes", begin: int = 350, end: int = 351) -> DataFrame:
    """Stream (session, seq, ts, code) to its sentences: session, start_seq, start_at, end_seq, end_at.

    An end whose latest mark (start or end) is a start, no further back than `bound`, makes a sentence with it.
    Marks are gathered by windows of twice the bound that begin at every multiple of it, so that each end has all
    marks within the bound before it in the window whose second half it lies in; that one gives its sentence, once
    the watermark has passed the window, whose state is dropped then. So a mark is kept twice and met by its
    neighbours alone, however many there are within the bound. A late mark counts in windows that are still open.
    The watermark moves with starts and ends alone: other rows are filtered before times are measured.
    """
    marked = events.withWatermark("ts", late).filter(F.col("code").isin(begin, end))
    window = F.window("ts", f"{2 * _seconds(bound)} seconds", f"{_seconds(bound)} seconds")
    mark = F.struct("session", F.col("ts").alias("at"), "seq", "code")
    held = marked.groupBy(window.alias("w"), _bucket()).agg(F.sort_array(F.collect_list(mark)).alias("m"))
    each = F.arrays_zip(F.expr("slice(m, 1, size(m) - 1)").alias("a"), F.expr("slice(m, 2, size(m) - 1)").alias("b"))
    met = held.select("w", F.inline(each))
    meets = F.col("a.session").eqNullSafe(F.col("b.session")) & (F.col("a.code") == begin) & (F.col("b.code") == end)
    step = F.expr(f"INTERVAL {_seconds(bound)} SECONDS")
    met = met.filter(meets & (F.col("b.at") >= F.col("w.start") + step) & (F.col("a.at") >= F.col("b.at") - step))
    return met.select("b.session", F.col("a.seq").alias("start_seq"), F.col("a.at").alias("start_at"), F.col("b.seq").alias("end_seq"), F.col("b.at").alias("end_at"))


def _seconds(interval: str) -> int:
    """Whole seconds of an interval as "6 hours" (of days at most)."""
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.removesuffix("s")]


_FINAL = "session string, started_at timestamp, ended_at timestamp, state string, chunks long, bytes long"
_STATES = {52: "closed", 152: "ended", 352: "data", 150: "started"}
def _in_order(rows: Iterator):
    """A bucket's rows by session, time and seq, as arrays: sessions' names, number of each row's session (null last), us, the frame."""
    import numpy as np
    import pandas as pd

    df = pd.concat(list(rows), ignore_index=True)
    number, names = pd.factorize(df["session"])
    number = np.where(number < 0, len(names), number)
    us = df["ts"].to_numpy("datetime64[us]").astype(np.int64)
    order = np.lexsort((df["seq"].to_numpy(), us, number))
    return [*names.tolist(), None], number[order], us[order], df.iloc[order]


class _Lifecycle(StatefulProcessor):
    """A bucket's open sessions: name, then bounds in microseconds, last seq and event, failure, chunks and bytes."""

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("open", "sessions string")

    def _open(self) -> dict:
        return {name: tuple(s) for name, *s in json.loads(self.held.get()[0])} if self.held.exists() else {}

    @staticmethod
    def _final(done: list):
        import numpy as np
        import pandas as pd

        name, first, last, _, code, failed, chunks, size = zip(*[(n, *s) for n, s in done])
        at = [pd.Series(np.array(v, dtype="datetime64[us]")) for v in (first, last)]
        state = ["failed" if f else _STATES.get(c, "connected") for f, c in zip(failed, code)]
        return pd.DataFrame({"session": list(name), "started_at": at[0], "ended_at": at[1], "state": state, "chunks": list(chunks), "bytes": list(size)})

    def _ends(self, s: tuple) -> int:
        """Millisecond at which a session has been idle for long enough."""
        return -(-(s[1] + self.idle) // 1000)

    def _keep(self, now: dict) -> None:
        """Stores open sessions; the bucket's only timer is the one that comes first."""
        for ms in list(self.handle.listTimers()):
            self.handle.deleteTimer(ms)
        if not now:
            self.held.clear()
            return
        self.held.update((json.dumps([(n, *s) for n, s in now.items()]),))
        self.handle.registerTimer(min(self._ends(s) for s in now.values()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np

        names, number, us, df = _in_order(rows)
        seq, code, size = (df[c].to_numpy() for c in ("seq", "code", "size"))
        new = np.ones(len(us), bool)
        new[1:] = (np.diff(number) != 0) | (np.diff(us) >= self.idle) | (code[:-1] == 52)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(us)) - 1
        data = code == 352
        sums = [np.add.reduceat(v, a).tolist() for v in (data.astype(np.int64), np.where(data, size, 0).astype(np.int64))]
        failed = np.logical_or.reduceat(np.isin(code, (51, 153)), a).tolist()
        runs = zip(number[a].tolist(), zip(us[a].tolist(), us[b].tolist(), seq[b].tolist(), code[b].tolist(), failed, *sums))
        every, done = self._open(), []
        for n, s in runs:
            name = names[n]
            now = every.pop(name, None)
            if now is not None and s[0] - now[1] < self.idle and now[0] - s[1] < self.idle:
                late = (s[1], s[2]) < (now[1], now[2])
                last = now if late else s
                s = (min(s[0], now[0]), *last[1:4], s[4] or now[4], s[5] + now[5], s[6] + now[6])
            elif now is not None:
                early, s = sorted((now, s))
                done.append((name, early))
            if s[3] == 52:
                done.append((name, s))
            else:
                every[name] = s
        self._keep(every)
        if done:
            yield self._final(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        every, now = self._open(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        done = [(n, s) for n, s in every.items() if self._ends(s) <= now]
        self._keep({n: s for n, s in every.items() if self._ends(s) > now})
        if done:
            yield self._final(done)

    def close(self) -> None:
        pass


def lifecycles(events: DataFrame, idle_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Stream (session, seq, ts, code, size) to its sessions: bounds, final state, chunks and bytes.

    A session ends at its closing event (52), or by an event-time timer when nothing came for
    idle_seconds; it is given then, once, and its state is dropped. A failure (51, 153) from any state is
    final. Rows may come in any order within the watermark; a gap of idle_seconds within what has come
    ends a session at once. A null session is a key like others.
    """
    rows = _bucketed(events.withWatermark("ts", late).select("session", "seq", "ts", "code", "size"))
    return rows.transformWithStateInPandas(_Lifecycle(idle_seconds * 1_000_000), _FINAL, "Append", "EventTime")


_PIECES = "session string, state string, seq long, payload binary"


class _Assembly(StatefulProcessor):
    """A key's chunks, appended as they come, and whether it has ended."""

    def __init__(self, idle_minutes: int | None):
        self.idle = idle_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks, self.done = handle.getListState("chunks", "seq long, payload binary"), handle.getValueState("done", "done boolean")

    def _given(self, key: tuple, state: str) -> Iterator:
        """A row for the session, then its chunks as they are read from the state, a thousand or AT_ONCE bytes at a time."""
        import pandas as pd

        held, size = [(None, None)], 0
        for seq, payload in self.chunks.get():
            held.append((seq, payload))
            size += len(payload)
            if len(held) >= 1000 or size >= AT_ONCE:
                yield self._frame(pd, key, state, held)
                held, size = [], 0
        if held:
            yield self._frame(pd, key, state, held)
        self.chunks.clear()

    @staticmethod
    def _frame(pd, key: tuple, state: str, held: list):
        seq, payload = zip(*held)
        return pd.DataFrame({"session": [key[0]] * len(held), "state": [state] * len(held), "seq": pd.array(seq, dtype="Int64"), "payload": list(payload)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        if self.done.exists():
            return
        df = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        final = df["event"].isin((152, 52, 51, 153))
        if final.any():
            df = df.iloc[: int(final.to_numpy().argmax()) + 1]
        held = df[(df["event"] == 352) & df["payload"].notna()]
        if len(held):
            self.chunks.appendList([(int(s), bytes(p)) for s, p in zip(held["seq"], held["payload"])])
        if final.any():
            self.done.update((True,))
            yield from self._given(key, "ended" if df["event"].iloc[-1] in (152, 52) else "failed")
        elif self.idle is not None:
            for ms in list(self.handle.listTimers()):
                self.handle.deleteTimer(ms)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle * 60_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if not self.done.exists():
            yield from self._given(key, "idle")

    def close(self) -> None:
        pass


#: Bytes of payload that leave the state at a time.
AT_ONCE = 1 << 22


def pieces(frames: DataFrame, idle_minutes: int | None = None) -> DataFrame:
    """Decoded frames (session, seq, ts, event, payload) as a stream of finished sessions' chunks.

    Chunks are appended to keyed state as they come. At the session's first end (152, 52) or failure (51,
    153), or, if idle_minutes is set, when nothing came for so long, a row for the session (null seq) and a
    row for each chunk leave it; what comes later for a session that ended is dropped, and an idle one starts
    anew. No row holds a session: sessions.parts() puts the chunks in order.
    """
    mode = "None" if idle_minutes is None else "ProcessingTime"
    return frames.groupBy("session").transformWithStateInPandas(_Assembly(idle_minutes), _PIECES, "Append", mode)


_RELEASED = "session string, seq long, size long, opened_by string"


class _Gate(StatefulProcessor):
    """A bucket's gates: those that are open, by what opened them, and the others' bytes and chunks (seq, size)."""

    def __init__(self, chunks: int, volume: int, ends: tuple[int, ...]):
        self.limits, self.ends = (chunks, volume), ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("gates", "open string, shut string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        opened, shut = ({n: v for n, v in json.loads(x)} for x in self.held.get()) if self.held.exists() else ({}, {})
        names, number, _, df = _in_order(rows)
        seq, code, size = (df[c].to_numpy().astype(np.int64) for c in ("seq", "code", "size"))
        a = np.flatnonzero(np.append(True, np.diff(number) != 0))
        out = ([], [], [], [])
        for i, j in zip(a.tolist(), np.append(a[1:], len(number)).tolist()):
            name = names[number[i]]
            if name not in opened:
                waiting = shut.pop(name, [])
                volume = sum(n for _, n in waiting)
                while i < j and name not in opened:  # fewer than the gate's chunks pass before it opens
                    c, n = int(code[i]), int(size[i])
                    if c == 352:
                        waiting.append((int(seq[i]), n))
                        volume += n
                    why = "end" if c in self.ends else "chunks" if len(waiting) >= self.limits[0] else "bytes" if volume >= self.limits[1] else None
                    if why:
                        opened[name] = why
                    i += 1
                if name not in opened:
                    shut[name] = waiting
                    continue
                self._put(out, name, opened[name], *(zip(*waiting) if waiting else ((), ())))
            data = code[i:j] == 352
            self._put(out, name, opened[name], seq[i:j][data].tolist(), size[i:j][data].tolist())
        self.held.update((json.dumps(list(opened.items())), json.dumps(list(shut.items()))))
        if out[0]:
            yield pd.DataFrame(dict(zip(("session", "seq", "size", "opened_by"), out)))

    @staticmethod
    def _put(out: tuple, name: str | None, why: str, seq, size) -> None:
        for held, more in zip(out, ([name] * len(seq), seq, size, [why] * len(seq))):
            held.extend(more)

    def close(self) -> None:
        pass


def gates(events: DataFrame, chunks: int = 3, volume: int = 32_768, ends: tuple[int, ...] = (152,)) -> DataFrame:
    """Stream (session, seq, ts, code, size) to the chunks (352) that are released, each once, in order.

    A session's chunks wait in its state until there are `chunks` of them or `volume` bytes, or until an
    end event comes, which flushes what is there; from then on they pass. So a state holds fewer than
    `chunks` chunks. opened_by tells which it was: chunks, bytes or end.
    """
    rows = events.filter(F.col("code").isin(352, *ends)).select("session", "seq", "ts", "code", "size")
    return _bucketed(rows).transformWithStateInPandas(_Gate(chunks, volume, ends), _RELEASED, "Append", "None")


def to_sinks(rows: DataFrame, sinks: dict[str, str], checkpoint: str, route: str = "route", before: Callable[[int, str], None] | None = None) -> StreamingQuery:
    """One stream into several tables: a batch is kept once, and each route's rows go to its own folder.

    A sink holds a folder for each batch. A batch that is run again, after a failure between two sinks,
    replaces what it wrote before, so that each row is there once. before: called before each write.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, path in sinks.items():
                if before:
                    before(number, name)
                batch.filter(F.col(route) == name).drop(route).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
