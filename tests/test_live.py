"""Streams with state, played in several triggers: equal to their batch forms, bounded, safe to run again."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandline.plans import streams as P
from strandline.streaming import live, sessions

SF = "/root/testdata/sf0.001"


def at(minute):
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(60) * minute)


def arriving(spark, rows):
    """(session, seq, minute, code, size) as events."""
    return spark.createDataFrame(rows, "session string, seq long, minute long, code int, size long").withColumn("ts", at(F.col("minute"))).drop("minute").select("session", "seq", "ts", "code", "size")


def run(spark, folder, batches, start):
    """Each batch of rows arrives, then the stream runs from its checkpoint."""
    ran = []
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = start(live.stored(spark).readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/checkpoint")
        q.awaitTermination()
        ran.append(q)
    return ran


def test_sentences_by_a_stream_join(spark, tmp_path):
    """Many triggers over the events; state stays as small as the bound makes it."""
    rows, mark = P.arrivals(spark, SF)
    ran = live.replayed(rows, "ts", lambda r, c: live.to_table(f"{tmp_path}/out")(live.paired(r, "6 hours"), c), 6, mark)
    got = {(r.session, r.start_seq, r.end_seq) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    marks, want = {}, set()
    for r in sorted(rows.filter("code in (350, 351)").collect(), key=lambda r: (r.ts, r.seq)):
        last = marks.get(r.session)
        if r.code == 351 and last and last.code == 350 and (r.ts - last.ts).total_seconds() <= 6 * 3600:
            want.add((r.session, last.seq, r.seq))
        marks[r.session] = r
    assert got == want and got
    held = [sum(s["numRowsTotal"] for s in json.loads(q.lastProgress.json)["stateOperators"]) for q in ran if q.lastProgress]
    assert len(held) >= 6 and max(held) < 0.2 * rows.count()  # both sides and the aggregate, not what came before


def test_a_late_sentence_is_dropped(spark, tmp_path):
    first = arriving(spark, [("a", 1, 0, 350, 0), ("a", 2, 5, 351, 0), ("b", 3, 600, 350, 0)])
    late = arriving(spark, [("a", 4, 2, 350, 0), ("b", 5, 610, 351, 0)])
    end = arriving(spark, [("z", -1, 90_000, 351, 0)])
    run(spark, tmp_path, [first, late, end], lambda r, c: live.to_table(f"{tmp_path}/out")(live.paired(r, "1 hour"), c))
    assert {(r.session, r.start_seq, r.end_seq) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", 1, 2), ("b", 3, 5)}


def test_dense_sentences_keep_windows_not_marks(spark, tmp_path):
    """State and work do not grow with the marks within the bound of each other; the null session is one like others."""
    rows = [(s, 4000 * (s is None) + k, k // 50, 350 + k % 2, 0) for s in ("a", None) for k in range(4000)]
    batches = [arriving(spark, x) for x in (rows[:2000] + rows[4000:6000], rows[2000:4000] + rows[6000:], [("z", -1, 90_000, 351, 0)])]
    ran = run(spark, tmp_path, batches, lambda r, c: live.to_table(f"{tmp_path}/out")(live.paired(r, "6 hours"), c))
    got = sorted((r.session or "", r.start_seq, r.end_seq) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((s or "", k - 1, k) for s, k, _, code, _ in rows if code == 351)
    assert max(o["numRowsTotal"] for q in ran for p in q.recentProgress for o in json.loads(p.json)["stateOperators"]) <= 8


def test_sessions_end_by_timer_or_close_and_once(spark, tmp_path):
    one = [("a", 1, 0, 50, 0), ("a", 2, 1, 352, 7), ("b", 3, 1, 352, 5), ("c", 4, 2, 50, 0), (None, 5, 2, 352, 1)]
    two = [("a", 6, 3, 352, 4), ("b", 7, 2, 153, 0), ("c", 8, 3, 52, 0), ("c", 9, 4, 150, 0), ("d", 10, 300, 352, 2), ("d", 11, 301, 352, 2), ("d", 12, 400, 152, 0)]
    three = [("a", 13, 500, 352, 1), ("a", 14, 700, 352, 1)]
    out = f"{tmp_path}/out"
    batches = [arriving(spark, x) for x in (one, two, three, [("z", -1, 90_000, 0, 0)])]
    run(spark, tmp_path, batches, lambda r, c: live.to_table(out)(live.lifecycles(r, 3600, "1 minute"), c))
    got = sorted((r.session or "", int(r.started_at.timestamp() - 1_700_000_000) // 60, r.state, r.chunks, r.bytes) for r in spark.read.parquet(out).collect())
    assert got == [("", 2, "data", 1, 1), ("a", 0, "data", 2, 11), ("a", 500, "data", 1, 1), ("a", 700, "data", 1, 1), ("b", 1, "failed", 1, 5), ("c", 2, "closed", 0, 0), ("c", 4, "started", 0, 0), ("d", 300, "data", 2, 4), ("d", 400, "ended", 0, 0)]


def test_one_long_session_equals_the_batch_form(spark, tmp_path):
    rows, mark = P.arrivals(spark, SF)
    rows = rows.withColumn("session", F.when(F.col("seq") % 3 == 0, "hot").otherwise(F.col("session")))
    out = f"{tmp_path}/out"
    live.replayed(rows, "ts", lambda r, c: live.to_table(out)(live.lifecycles(r, 90 * 86_400), c), 4, mark.withColumn("ts", F.col("ts") + F.expr("INTERVAL 200 days")))
    got = {(r.session, r.state, r.chunks, r.bytes) for r in spark.read.parquet(out).filter("session <> ''").collect()}
    assert got == set(map(tuple, sessions.lifecycle(rows, "session", ["ts", "seq"], "code", F.col("size")).collect()))


def test_assembled_sessions_leave_the_state_by_pieces(spark, tmp_path, monkeypatch):
    r = [("hot", k, 352, bytes([k % 256]) * (k % 50)) for k in range(2000)] + [("hot", 2000, 152, None), ("b", 1, 352, b"q"), ("b", 2, 153, None), ("c", 1, 352, b"open"), ("e", 1, 52, None)]
    late = [("hot", 3000, 352, b"late"), ("b", 0, 352, b"late"), ("c", 0, 352, b"still ")]
    frame = lambda x: spark.createDataFrame(x, "session string, seq long, event int, payload binary").withColumn("ts", at(F.col("seq")))
    out = f"{tmp_path}/out"
    halves = [frame(r[:900]), frame(r[900:]), frame(late), frame([("c", 2, 52, None)])]
    run(spark, tmp_path, halves, lambda s, c: live.to_table(out)(live.pieces(s), c))
    rows = spark.read.parquet(out)
    assert {(x.session, x.state) for x in rows.filter("seq is null").collect()} == {("hot", "ended"), ("b", "failed"), ("c", "ended"), ("e", "ended")} and rows.filter("seq is null").count() == 4
    made = sessions.parts(rows.filter("seq is not null"), "session", ["seq"], "payload", 4096)
    want = {"hot": b"".join(x[3] for x in r[:2000]), "b": b"q", "c": b"still open"}
    assert {x.session: x.digest for x in sessions.digested(made, "session").collect()} == {s: hashlib.md5(v).hexdigest() for s, v in want.items()}
    assert made.filter("session = 'hot'").count() == len(want["hot"]) // 4096 + 1 and made.agg(F.max("bytes")).first()[0] < 4096 + 50


def test_a_batch_that_fails_between_sinks_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(k, "even" if k % 2 == 0 else "odd") for k in range(40)], "k long, route string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    sinks = {"even": f"{tmp_path}/even", "odd": f"{tmp_path}/odd"}
    broken = []

    def fail(number, name):
        if name == "odd" and not broken:
            broken.append(number)
            raise RuntimeError("between two sinks")

    def start(before):
        return live.to_sinks(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), sinks, f"{tmp_path}/c", before=before)

    with pytest.raises(Exception, match="between two sinks"):
        start(fail).awaitTermination()
    assert spark.read.parquet(sinks["even"]).count() == 20
    start(None).awaitTermination()
    assert broken == [0] and [sorted(r.k for r in spark.read.parquet(sinks[s]).collect()) for s in ("even", "odd")] == [list(range(0, 40, 2)), list(range(1, 40, 2))]
    start(None).awaitTermination()
    assert spark.read.parquet(sinks["odd"]).count() == 20


def test_late_and_repeated_rows_of_windows(spark, tmp_path):
    first = arriving(spark, [("a", 1, 0, 0, 0), ("a", 1, 0, 0, 0), ("a", 2, 10, 0, 0), ("b", 3, 500, 0, 0)])
    again = arriving(spark, [("a", 2, 10, 0, 0), ("a", 4, 20, 0, 0), ("b", 3, 500, 0, 0), ("b", 5, 510, 0, 0)])  # the first two are late by hours
    end = arriving(spark, [("z", -1, 90_000, 0, 0)])
    out = f"{tmp_path}/out"
    ran = run(spark, tmp_path, [first, again, end], lambda r, c: live.to_table(out)(sessions.session_windows(r, "session", "ts", key="seq"), c))
    assert {(r.session, r.n) for r in spark.read.parquet(out).collect()} == {("a", 2), ("b", 2)}
    dropped = [sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in json.loads(p.json)["stateOperators"]) for q in ran]
    assert dropped[0] == 0 and dropped[1] == 2
    twins = [s["customMetrics"].get("numDroppedDuplicateRows", 0) for p in ran[0].recentProgress for s in json.loads(p.json)["stateOperators"]]
    assert sum(twins) == 1


def test_gates_hold_few_chunks_and_let_each_through_once(spark, tmp_path):
    one = [("a", 1, 0, 352, 5), ("a", 2, 1, 352, 5), ("b", 3, 0, 352, 5), ("c", 4, 0, 352, 99), ("d", 5, 0, 352, 1)]
    two = [("a", 6, 2, 352, 5), ("a", 7, 3, 352, 5), ("b", 8, 4, 152, 0), ("b", 9, 5, 352, 5), ("c", 10, 1, 352, 1), (None, 11, 0, 352, 50)]
    three = [("a", 12, 9, 352, 5), ("d", 13, 9, 350, 7)]
    out = f"{tmp_path}/out"
    run(spark, tmp_path, [arriving(spark, x) for x in (one, two, three)], lambda r, c: live.to_table(out)(live.gates(r, 3, 40), c))
    got = sorted((r.seq, r.session, r.opened_by) for r in spark.read.parquet(out).collect())
    want = [(1, "a", "chunks"), (2, "a", "chunks"), (3, "b", "end"), (4, "c", "bytes"), (6, "a", "chunks"), (7, "a", "chunks"), (9, "b", "end"), (10, "c", "bytes"), (11, None, "bytes"), (12, "a", "chunks")]
    assert got == want  # d still waits


@pytest.mark.parametrize("kind", ["lifecycles", "gates"])
def test_sessions_share_state(spark, tmp_path, monkeypatch, kind):
    """300 sessions are a few rows of state, and none gets another's chunks."""
    monkeypatch.setattr(live, "BUCKETS", 4)
    rows = [(f"s{k % 300}", k, k // 300, 352, k % 300) for k in range(600)]
    start = {"lifecycles": lambda r, c: live.to_table(f"{tmp_path}/out")(live.lifecycles(r, 3600), c), "gates": lambda r, c: live.to_table(f"{tmp_path}/out")(live.gates(r, 2, 1 << 30), c)}[kind]
    batches = [arriving(spark, rows)] + ([arriving(spark, [("z", -1, 90_000, 351, 0)])] if kind == "lifecycles" else [])
    ran = run(spark, tmp_path, batches, start)
    held = [s["numRowsTotal"] for p in ran[0].recentProgress for s in json.loads(p.json)["stateOperators"]]
    assert held and max(held) <= 40
    out = spark.read.parquet(f"{tmp_path}/out")
    got = {r[0]: tuple(r)[1:] for r in (out.groupBy("session").agg(F.sum("chunks"), F.sum("bytes")) if kind == "lifecycles" else out.groupBy("session").agg(F.count("*"), F.sum("size"))).collect()}
    assert got == {f"s{k}": (2, 2 * k) for k in range(300)}
