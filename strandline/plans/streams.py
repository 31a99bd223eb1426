"""Queries of frames and sessions, on tables and as streams that play the tables' rows by time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strandline.functions import binary
from strandline.plans.base import Registry, table
from strandline.sources.folders import scratch
from strandline.streaming import frames as X
from strandline.streaming import live as V
from strandline.streaming import sessions as Z

R = Registry()
_CODE = "CASE WHEN event_id % 97 = 0 THEN 153 ELSE [50, 150, 350, 351, 352, 352, 152][event_id % 7 + 1] END"
_EV = f"SELECT *, ({_CODE})::INT AS code, octet_length(encode(props)) AS size FROM events"


def coded(spark, d):
    codes = F.element_at(F.array(*[F.lit(c) for c in (50, 150, 350, 351, 352, 352, 152)]), (F.col("event_id") % 7 + 1).cast("int"))
    code = F.when(F.col("event_id") % 97 == 0, 153).otherwise(codes)
    return table(spark, d, "events").withColumns({"code": code, "size": F.length(F.encode("props", "UTF-8")).cast("long")})


def framed(spark, d):
    """Frames built from events; every 50th is cut short."""
    session = F.encode(F.col("user_id").cast("string"), "UTF-8")
    whole = binary.frame(0xB, 4, 1, F.col("code"), session, F.encode("props", "UTF-8"))
    value = F.when(F.col("event_id") % 50 == 0, F.substring(whole, 1, 10)).otherwise(whole)
    return coded(spark, d).select("event_id", "user_id", "ts", value.alias("value"))


_SECOND = "code IN (350, 351, 352, 152, 153)"


@R.add("X01_decode", f"""SELECT event_id, 11 AS kind, 4 AS flags, code AS event, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id::VARCHAR END AS id,
    CASE WHEN event_id % 50 = 0 OR NOT {_SECOND} THEN NULL ELSE props END AS payload, CASE WHEN event_id % 50 = 0 THEN 'cut short' END AS reason FROM ({_EV})""")
def decode(spark, d):
    return X.decoded(framed(spark, d)).select("event_id", "kind", "flags", "event", "id", F.decode("payload", "UTF-8").alias("payload"), "reason")


_ROUTE = "CASE WHEN code = 352 THEN 'audio' WHEN code IN (51, 153) THEN 'failure' WHEN code IN (350, 351) THEN 'text' WHEN code IN (152, 52) THEN 'end' ELSE 'other' END"


@R.add("X02_routes", f"SELECT event_id, {_ROUTE} AS route FROM ({_EV})")
def routes(spark, d):
    return X.routed(X.decoded(framed(spark, d))).select("event_id", "route")


def frame_rows(spark, d):
    """Frames as they arrive: session, seq, ts, value."""
    return framed(spark, d).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "value")


@R.add("X02_sinks", f"SELECT event_id, {_ROUTE} AS route FROM ({_EV})")
def sinks(spark, d):
    """A stream of frames, each batch of it into a table for each route, read back from there."""
    paths = {r: scratch(spark, f"route-{r}") for r in ("audio", "failure", "text", "end", "other")}
    V.replayed(frame_rows(spark, d), "ts", lambda rows, checkpoint: V.to_sinks(X.routed(X.decoded(rows)).select("seq", "route"), paths, checkpoint))
    read = [spark.read.schema("seq long").parquet(p).select(F.col("seq").alias("event_id"), F.lit(r).alias("route")) for r, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b), read)


def arrivals(spark, d):
    """Events as they arrive (session, seq, ts, code, size), and a last row, of the session "", that moves the
    watermark on: an end without a start or a size, since rows that a query filters don't count for it."""
    rows = coded(spark, d).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "code", "size")
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 30 days")).alias("ts"))
    return rows, last.select(F.lit("").alias("session"), F.lit(-1).cast("long").alias("seq"), "ts", F.lit(351).alias("code"), F.lit(0).cast("long").alias("size"))


_STATE = "CASE WHEN bool_or(code IN (51, 153)) THEN 'failed' WHEN last = 52 THEN 'closed' WHEN last = 152 THEN 'ended' WHEN last = 352 THEN 'data' WHEN last = 150 THEN 'started' ELSE 'connected' END"


@R.add("X03_stream", f"""SELECT session, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, {_STATE} AS state, count(*) FILTER (code = 352) AS chunks, coalesce(sum(size) FILTER (code = 352), 0)::BIGINT AS bytes
    FROM (SELECT *, last_value(code) OVER (PARTITION BY session, g ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, user_id::VARCHAR AS session, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 86400000000 THEN 0 ELSE 1 END AS new FROM ({_EV})))) GROUP BY session, g, last""")
def lifecycle_stream(spark, d):
    """Sessions of a stream, ended by a timer after a day without events."""
    path = scratch(spark, "lifecycles")
    rows, mark = arrivals(spark, d)
    V.replayed(rows, "ts", lambda r, c: V.to_table(path)(V.lifecycles(r, 86_400), c), mark=mark)
    us = [F.expr(f"unix_micros({c}_at)").alias(f"{c}_us") for c in ("started", "ended")]
    return spark.read.parquet(path).filter("session <> ''").select("session", *us, "state", "chunks", "bytes")


@R.add("X03_lifecycle", f"""SELECT user_id, CASE WHEN bool_or(code IN (51, 153)) THEN 'failed' WHEN last = 52 THEN 'closed' WHEN last = 152 THEN 'ended' WHEN last = 352 THEN 'data' WHEN last = 150 THEN 'started' ELSE 'connected' END AS state,
    count(*) FILTER (code = 352) AS chunks, coalesce(sum(size) FILTER (code = 352), 0)::BIGINT AS bytes FROM (SELECT *, last_value(code) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM ({_EV})) GROUP BY user_id, last""")
def lifecycle(spark, d):
    return Z.lifecycle(coded(spark, d), "user_id", ["ts", "event_id"], "code", F.col("size"))


@R.add("X04_assembled", f"SELECT user_id, md5(string_agg(props, '' ORDER BY event_id)) AS digest, count(*) AS chunks, sum(size)::BIGINT AS bytes FROM ({_EV}) WHERE code = 352 GROUP BY user_id")
def assembled(spark, d):
    rows = coded(spark, d).filter("code = 352").withColumn("payload", F.encode("props", "UTF-8"))
    return Z.digested(Z.parts(rows, "user_id", ["event_id"], "payload"), "user_id")


@R.add("A13_ordered", "SELECT conv_id, string_agg(text, '' ORDER BY turn, role, text) AS whole, count(*) AS chunks, sum(octet_length(encode(text)))::BIGINT AS bytes FROM conversations GROUP BY conv_id")
def ordered(spark, d):
    rows = table(spark, d, "conversations").withColumn("payload", F.encode("text", "UTF-8"))
    return Z.assembled(rows, "conv_id", ["turn", "role", "text"], "payload").select("conv_id", F.decode("whole", "UTF-8").alias("whole"), "chunks", "bytes")


_PART = f"SELECT *, coalesce(sum(size) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT *, user_id % 3 = 0 AS session FROM ({_EV})) WHERE code = 352"


@R.add("A13_parts", f"SELECT session, start // 512 AS part, min(start) AS start, count(*) AS chunks, sum(size)::BIGINT AS bytes, md5(string_agg(props, '' ORDER BY ts, event_id)) AS digest FROM ({_PART}) GROUP BY 1, 2")
def parted(spark, d):
    """Two sessions, one of a third of all chunks, as parts of half a kilobyte."""
    rows = coded(spark, d).filter("code = 352").withColumns({"session": F.col("user_id") % 3 == 0, "payload": F.encode("props", "UTF-8")})
    made = Z.parts(rows, "session", ["ts", "event_id"], "payload", 512)
    return made.select("session", "part", "start", "chunks", "bytes", F.md5("whole").alias("digest"))


@R.add("X05_gate", f"SELECT event_id, count(*) OVER w >= 3 OR sum(size) OVER w >= 24 AS released FROM ({_EV}) WHERE code = 352 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def gate(spark, d):
    return Z.gated(coded(spark, d).filter("code = 352"), "user_id", ["ts", "event_id"], "size", 3, 24).select("event_id", "released")


@R.add("X07_flush", f"""SELECT event_id, count(*) OVER w >= 30 OR user_id IN (SELECT user_id FROM ({_EV}) WHERE code = 152) AS released FROM ({_EV}) WHERE code = 352 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def flush(spark, d):
    rows = coded(spark, d)
    done = rows.filter("code = 152").select("user_id", F.lit(True).alias("done")).distinct()
    held = rows.filter("code = 352").join(done, "user_id", "left")
    return Z.gated(held, "user_id", ["ts", "event_id"], "size", 30, 1 << 40, F.coalesce("done", F.lit(False))).select("event_id", "released")


_OPENS = f"""SELECT session, CASE arg_min(why, place) WHEN 0 THEN 'end' WHEN 1 THEN 'chunks' ELSE 'bytes' END AS opened_by FROM (SELECT user_id::VARCHAR AS session, struct_pack(ts, event_id) AS place,
    CASE WHEN code = 152 THEN 0 WHEN count(*) FILTER (code = 352) OVER w >= 4 THEN 1 WHEN sum(size) FILTER (code = 352) OVER w >= 40 THEN 2 END AS why FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE why IS NOT NULL GROUP BY session"""


@R.add("X07_stream", f"SELECT o.session, event_id, size::BIGINT AS size, opened_by FROM ({_OPENS}) o JOIN ({_EV}) e ON o.session = e.user_id::VARCHAR WHERE code = 352")
def gate_stream(spark, d):
    """Chunks that a gate of four chunks or forty bytes, or the end of their session, has let through."""
    path = scratch(spark, "released")
    rows, _ = arrivals(spark, d)
    V.replayed(rows, "ts", lambda r, c: V.to_table(path)(V.gates(r, 4, 40), c), 4)
    return spark.read.parquet(path).select("session", F.col("seq").alias("event_id"), "size", "opened_by")


@R.add("X08_spoken", f"""SELECT user_id, s AS start_at, e AS end_at, e - s AS length FROM (SELECT user_id, code, epoch_us(ts) AS s, lead(code) OVER w AS n, lead(epoch_us(ts)) OVER w AS e FROM ({_EV}) WHERE code IN (350, 351) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE code = 350 AND n = 351""")
def spoken(spark, d):
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return Z.spoken(coded(spark, d).withColumn("us", us), "user_id", ["ts", "event_id"], "code", "us")


@R.add("X08_stream", f"""SELECT user_id::VARCHAR AS session, s AS start_at, e AS end_at, e - s AS length FROM (SELECT user_id, code, epoch_us(ts) AS e, lag(code) OVER w AS p, lag(epoch_us(ts)) OVER w AS s FROM ({_EV}) WHERE code IN (350, 351) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE code = 351 AND p = 350 AND e - s <= 21600000000""")
def spoken_stream(spark, d):
    """Sentences of at most six hours, from windows of a stream."""
    path = scratch(spark, "sentences")
    rows, mark = arrivals(spark, d)
    V.replayed(rows, "ts", lambda r, c: V.to_table(path)(V.paired(r, "6 hours"), c), mark=mark)
    us = F.expr("unix_micros(start_at)"), F.expr("unix_micros(end_at)")
    return spark.read.parquet(path).select("session", us[0].alias("start_at"), us[1].alias("end_at"), (us[1] - us[0]).alias("length"))


def _sliding(width: int, slide: int) -> str:
    n = width // slide
    return f"""SELECT epoch_us(start_at) AS start_us, count(*) AS chunks, sum(size)::BIGINT AS bytes FROM (SELECT size, time_bucket(INTERVAL '{slide} minutes', ts) - k * INTERVAL '{slide} minutes' AS start_at FROM ({_EV}), range({n}) r(k)) GROUP BY 1"""


_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', start_at)"


@R.add("X09_gauge", f"SELECT *, bytes < 80 AS low FROM ({_sliding(10, 5)})")
def gauge(spark, d):
    rows = Z.counted(coded(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "size", "10 minutes", "5 minutes")
    return rows.withColumn("start_at", F.col("start_at").cast("timestamp_ntz")).select(F.expr(_US).alias("start_us"), "chunks", F.col("bytes").cast("long").alias("bytes"), (F.col("bytes") < 80).alias("low"))


_SIGNED = "CASE WHEN code = 352 THEN size WHEN code IN (350, 351) THEN -size ELSE 0 END"


@R.add("X09_balance", f"SELECT epoch_us(start_at) AS start_us, came, went, balance, balance < 0 AS low FROM (SELECT *, (sum(came - went) OVER (ORDER BY start_at ROWS UNBOUNDED PRECEDING))::BIGINT AS balance FROM (SELECT time_bucket(INTERVAL '10 minutes', ts) AS start_at, coalesce(sum(size) FILTER (code = 352), 0)::BIGINT AS came, coalesce(sum(size) FILTER (code IN (350, 351)), 0)::BIGINT AS went FROM ({_EV}) GROUP BY 1))")
def balance(spark, d):
    """What came in and went out by windows, and what is left after each: its deltas as a stream, summed over them."""
    path = scratch(spark, "deltas")
    rows, mark = arrivals(spark, d)
    V.replayed(rows, "ts", lambda r, c: V.to_table(path)(Z.deltas(r, "ts", F.col("code") == 352, F.col("code").isin(350, 351), "size"), c), mark=mark)
    return Z.balanced(spark.read.parquet(path), 0).select(F.expr("unix_micros(start_at)").alias("start_us"), "came", "went", "balance", "low")


@R.add("X10_counter", _sliding(10, 10))
def counter(spark, d):
    rows = Z.counted(coded(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "size", "10 minutes")
    return rows.withColumn("start_at", F.col("start_at").cast("timestamp_ntz")).select(F.expr(_US).alias("start_us"), "chunks", F.col("bytes").cast("long").alias("bytes"))


_SESSIONS = """SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g"""


@R.add("X11_sessions", _SESSIONS)
def sessions(spark, d):
    rows = Z.session_windows(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
    return rows.withColumn("start_at", F.col("start_at").cast("timestamp_ntz")).select("user_id", F.expr(_US).alias("start_us"), "n")


@R.add("X11_repeated", _SESSIONS)
def repeated(spark, d):
    """Sessions of events that all arrive twice."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = Z.session_windows(rows.unionByName(rows), "user_id", "ts", key="event_id")
    return found.withColumn("start_at", F.col("start_at").cast("timestamp_ntz")).select("user_id", F.expr(_US).alias("start_us"), "n")


@R.add("X11_stream", _SESSIONS)
def sessions_stream(spark, d):
    """Sessions of a stream in which all events arrive twice."""
    path = scratch(spark, "windows")
    rows, mark = arrivals(spark, d)
    V.replayed(rows.unionByName(rows), "ts", lambda r, c: V.to_table(path)(Z.session_windows(r, "session", "ts", key="seq"), c), mark=mark)
    found = spark.read.parquet(path).filter("session <> ''")
    return found.select(F.col("session").cast("long").alias("user_id"), F.expr("unix_micros(start_at)").alias("start_us"), "n")
