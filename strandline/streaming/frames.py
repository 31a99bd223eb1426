"""Binary event frames: decoding by column functions, alike in batch and streams, and routing.

A frame has four header bytes, then, if the flags are 4, an event number, then fields with their
lengths (four bytes, big-endian). Which fields follow depends on the event. A frame that is cut short
gives null fields and a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.binary import byte_at, int32

# Event numbers of the protocol.
CONNECTED, CONNECTION_FAILED, CONNECTION_ENDED = 50, 51, 52
SESSION_STARTED, SESSION_ENDED, SESSION_FAILED = 150, 152, 153
SENTENCE_START, SENTENCE_END, PAYLOAD = 350, 351, 352
ERROR_KIND, SERVER_KIND, AUDIO_KIND = 15, 9, 11


def _field(b: Column, at: Column) -> tuple[Column, Column]:
    """The bytes of a field that starts at `at` (from 1), and the place after it; null if cut short."""
    size = int32(b, at)
    whole = size.isNotNull() & (size >= 0) & (at + 3 + size <= F.length(b))
    return F.when(whole, F.substring(b, at + 4, size)), F.when(whole, at + 4 + size)


def decoded(df: DataFrame, value: str = "value") -> DataFrame:
    """df with the frame's fields: kind, flags, event, id, payload, error_code, reason."""
    b = F.col(value)
    high = lambda n: F.shiftright(byte_at(b, n), 4)
    low = lambda n: byte_at(b, n).bitwiseAND(15)
    df = df.withColumns({"version": high(1), "header_size": low(1), "kind": high(2), "flags": low(2), "serialisation": high(3), "compression": low(3), "reserved": byte_at(b, 4)})
    served = F.col("kind").isin(SERVER_KIND, AUDIO_KIND)
    df = df.withColumn("event", F.when(served & (F.col("flags") == 4), int32(b, 5))).withColumn("error_code", F.when(F.col("kind") == ERROR_KIND, int32(b, 5)))
    one, after = _field(b, F.lit(9))
    df = df.withColumns({"one_": one, "after_": after})
    two, _ = _field(b, F.col("after_"))
    second = F.col("event").isin(CONNECTION_FAILED, PAYLOAD, SENTENCE_START, SENTENCE_END, SESSION_ENDED, SESSION_FAILED)
    known = second | F.col("event").isin(CONNECTED, SESSION_STARTED)
    payload = F.when(F.col("kind") == ERROR_KIND, F.col("one_")).when(second, two)
    reason = (
        F.when(F.length(b) < 4, "no header").when(served & (F.col("flags") == 4) & F.col("event").isNull(), "no event")
        .when(known & F.col("one_").isNull(), "cut short").when(second & two.isNull(), "cut short")
    )
    df = df.withColumn("id", F.when(known, F.decode("one_", "UTF-8"))).withColumn("payload", payload).withColumn("reason", reason)
    return df.drop("one_", "after_")


def routed(df: DataFrame) -> DataFrame:
    """Decoded frames with their route: audio, failure, text, end or other. Audio needs event and kind."""
    e = F.col("event")
    route = (
        F.when((e == PAYLOAD) & (F.col("kind") == AUDIO_KIND), "audio").when(e.isin(CONNECTION_FAILED, SESSION_FAILED) | (F.col("kind") == ERROR_KIND), "failure")
        .when(e.isin(SENTENCE_START, SENTENCE_END), "text").when(e.isin(SESSION_ENDED, CONNECTION_ENDED), "end").otherwise("other")
    )
    return df.withColumn("route", route)


def frame_stream(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """A stream of frames (session, seq, ts, value) from Parquet files; files_each limits a trigger's intake."""
    schema = "session string, seq long, ts timestamp, value binary"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)
