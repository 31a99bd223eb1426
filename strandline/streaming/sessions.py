"""Sessions of events in tables: lifecycle, assembly by parts, gates, windows. live.py has them as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.order import scanned

def lifecycle(df: DataFrame, group: str, place: list[str], code: str, size: Column) -> DataFrame:
    """Final state, chunks and bytes of each session: connected 50, started 150, data 352, ended 152,
    closed 52; a failure (51, 153) from any state is final."""
    last = F.max_by(F.col(code), F.struct(*place))
    failed = F.bool_or(F.col(code).isin(51, 153))
    state = F.when(failed, "failed").when(last == 52, "closed").when(last == 152, "ended").when(last == 352, "data").when(last == 150, "started").otherwise("connected")
    data = F.col(code) == 352
    return df.groupBy(group).agg(state.alias("state"), F.count_if(data).alias("chunks"), F.coalesce(F.sum(F.when(data, size)), F.lit(0)).cast("long").alias("bytes"))


#: Bytes of a part of a session, about: a chunk belongs to the part that it starts in.
PART = 8 << 20


def parts(df: DataFrame, group: str, order: list[str], payload: str, size: int = PART) -> DataFrame:
    """A session's payloads (bytes) in order, as parts: group, part, start (bytes before it), chunks, bytes, whole.

    Chunks are placed by sums of the sizes before them, so a session of any length is as many rows as it
    has parts. A null payload is a chunk without bytes.
    """
    rows = df.select(group, *order, F.coalesce(payload, F.lit(b"")).alias("payload_"))
    rows = scanned(rows, [group], order, start_=("sum", F.length("payload_").cast("long")))
    rows = rows.withColumns({"part": F.expr(f"start_ div {size}"), "place_": F.struct(*order)})
    whole = F.expr("listagg(payload_) WITHIN GROUP (ORDER BY place_)")
    return rows.groupBy(group, "part").agg(F.min("start_").alias("start"), F.count("*").alias("chunks"), F.sum(F.length("payload_")).alias("bytes"), whole.alias("whole"))


def digested(made: DataFrame, group: str) -> DataFrame:
    """Of parts(): each session's md5, chunks and bytes. Its parts go through one digest in order, one at a time."""
    rows = made.select(group, "part", "chunks", "bytes", "whole").repartition(group).sortWithinPartitions(group, "part")
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        held: list | None = None

        def row():
            columns = [pa.array([held[0]], schema.field(0).type), pa.array([held[1].hexdigest()]), pa.array([held[2]], pa.int64()), pa.array([held[3]], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, [group, "digest", "chunks", "bytes"])

        for b in batches:
            schema = b.schema
            for session, chunks, size, whole in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                if held is None or held[0] != session:
                    if held is not None:
                        yield row()
                    held = [session, hashlib.md5(), 0, 0]
                held[1].update(whole.as_buffer())
                held[2] += chunks
                held[3] += size
        if held is not None:
            yield row()

    return rows.mapInArrow(run, f"`{group}` {kind}, digest string, chunks long, bytes long")


def assembled(df: DataFrame, group: str, order: list[str], payload: str) -> DataFrame:
    """A session's payloads (bytes) in order as one value, with their number and size, where a row can hold it."""
    rows = df.select(group, F.struct(*order).alias("place_"), F.col(payload).alias("payload_"))
    out = rows.groupBy(group).agg(F.expr("listagg(payload_) WITHIN GROUP (ORDER BY place_)").alias("whole"), F.count("*").alias("chunks"))
    return out.withColumn("bytes", F.length("whole").cast("long"))


def gated(df: DataFrame, group: str, order: list[str], size: str, chunks: int = 3, volume: int = 32_768, complete: Column | None = None) -> DataFrame:
    """Rows with `released`: from the row on at which enough chunks or bytes are held, or all if the
    session's input is complete."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    open_ = (F.count("*").over(w) >= chunks) | (F.sum(size).over(w) >= volume)
    return df.withColumn("released", open_ | (F.lit(False) if complete is None else complete))


def spoken(df: DataFrame, group: str, order: list[str], code: str, at: str) -> DataFrame:
    """Sentence starts (350) with the next end (351) of their session: start, end, length."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = df.filter(F.col(code).isin(350, 351)).withColumns({"next_": F.lead(code).over(w), "end_at": F.lead(at).over(w)})
    return rows.filter((F.col(code) == 350) & (F.col("next_") == 351)).select(group, F.col(at).alias("start_at"), "end_at", (F.col("end_at") - F.col(at)).alias("length"))


def counted(df: DataFrame, ts: str, size: str, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Chunks and bytes by time window; with a watermark, so that it also runs as a stream."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = df.withWatermark(ts, late).groupBy(window.alias("w")).agg(F.count("*").alias("chunks"), F.sum(size).alias("bytes"))
    return out.select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "chunks", "bytes")


def deltas(df: DataFrame, ts: str, came: Column, went: Column, size: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """What comes in and goes out by time window (start_at, came, went); also as a stream."""
    taken = lambda c: F.coalesce(F.sum(F.when(c, F.col(size))), F.lit(0)).cast("long")
    out = df.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(taken(came).alias("came"), taken(went).alias("went"))
    return out.select(F.col("w.start").alias("start_at"), "came", "went")


def balanced(windows: DataFrame, least: int) -> DataFrame:
    """deltas() with the balance after each window, carried from window to window, and whether it is low (under `least`)."""
    rows = scanned(windows, [], ["start_at"], before_=("sum", F.col("came") - F.col("went")))
    rows = rows.withColumn("balance", F.col("before_") + F.col("came") - F.col("went")).drop("before_")
    return rows.withColumn("low", F.col("balance") < least)


def session_windows(df: DataFrame, group: str, ts: str, idle: str = "30 minutes", late: str = "1 hour", key: str | None = None) -> DataFrame:
    """Sessions by idle time. With key, rows that repeat one count once: in a stream within the watermark."""
    rows = df.withWatermark(ts, late)
    if key:
        rows = rows.dropDuplicatesWithinWatermark([key]) if df.isStreaming else rows.dropDuplicates([key])
    out = rows.groupBy(F.session_window(ts, idle).alias("w"), group).agg(F.count("*").alias("n"))
    return out.select(group, F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")
