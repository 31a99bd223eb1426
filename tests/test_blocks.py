"""Signals and groups that are cut into blocks: against plain Python, with blocks of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import lexicon, order, signal
from strandline.streaming import sessions


@pytest.fixture
def hot(spark):
    """Samples of three series, one of them with most of the rows; silences of many lengths, ties, odd values."""
    r, rows = random.Random(7), []
    for series, n in ((1, 900), (2, 40), (None, 60), (4, 1)):
        k = 0
        while k < n:
            quiet = r.random() < 0.5
            for _ in range(min(r.randrange(1, 30), n - k)):
                rows.append((series, k, r.choice((0.0, 0.01)) if quiet else r.choice((-0.5, 0.3, 0.9))))
                k += 1
    return rows, spark.createDataFrame(rows, "series long, idx int, value double").repartition(6)


def by_series(rows):
    out = {}
    for s, k, v in sorted(rows, key=lambda x: x[1]):
        out.setdefault(s, []).append(v)
    return out


@pytest.mark.parametrize("bins, few", [(16, 3), (1024, 4096)])
def test_ranks_without_a_sort(spark, hot, monkeypatch, bins, few):
    monkeypatch.setattr(signal, "BINS", bins)
    monkeypatch.setattr(signal, "FEW", few)
    rows = hot[0] + [(5, k, v) for k, v in enumerate([1e-300, 1e300, -1e308, 1e308, 5e-324, 0.0, 3.0, 3.0, 3.0, -2.0, None, float("nan"), float("inf"), float("-inf"), 1e-320] * 3)] + [(6, 0, None)]
    df = spark.createDataFrame(rows, "series long, idx int, value double").repartition(5)
    ranks = {"least": F.lit(0), "third": F.floor(F.col("n") / 3), "half": F.floor(F.col("n") / 2), "last": F.col("n") - 1, "none": F.col("n")}
    got = {r.series: r for r in signal.ranked(df, "series", "value", ranks).collect()}
    for s, values in by_series(rows).items():
        v, n = sorted(max(-1.7976931348623157e308, min(1.7976931348623157e308, x)) for x in values if x is not None and x == x), None
        if v:
            n = len(v)
            assert (got[s].least, got[s].third, got[s].half, got[s].last, got[s].none) == (v[0], v[n // 3], v[n // 2], v[-1], None)
        else:
            assert s not in got or got[s].least is None


def test_thresholds(spark, hot):
    rows, df = hot
    got = {r.series: r.threshold for r in signal.adaptive_threshold(df).collect()}
    for s, values in by_series(rows).items():
        v = sorted(map(abs, values))
        assert got[s] == max(v[len(v) // 5], 0.15 * v[len(v) // 2])


def plain_runs(flags):
    out, k = [], 0
    while k < len(flags):
        e = k
        while e < len(flags) and flags[e] == flags[k]:
            e += 1
        out.append((flags[k], k, e - k, e if e < len(flags) else None))
        k = e
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_runs_over_blocks(spark, hot, monkeypatch, block):
    monkeypatch.setattr(signal, "BLOCK", block)
    rows, df = hot
    frames = df.select("series", F.col("idx").alias("frame"), (F.abs("value") < 0.1).alias("silent"))
    got = {(r.series, r.run, r.silent, r.a, r.n, r.b) for r in signal.runs(frames, "frame", "silent", block).collect()}
    flags = {s: [abs(v) < 0.1 for v in values] for s, values in by_series(rows).items()}
    assert got == {(s, k, *run) for s, f in flags.items() for k, run in enumerate(plain_runs(f), 1)}
    found, want = {(r.series, r.seg_no, r.a, r.b) for r in signal.voice_segments(frames, 5).collect()}, set()
    for s, f in flags.items():
        at, n = 0, 0
        for quiet, a, size, b in plain_runs(f):
            if quiet and size >= 5:
                want.add((s, n, at, a))
                at, n = b if b is not None else len(f), n + 1
        want.add((s, n, at, len(f)))
    assert found == want


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_cut_points_over_blocks(spark, hot, monkeypatch, block):
    monkeypatch.setattr(signal, "BLOCK", block)
    rows, df = hot
    got, want = sorted((r.series or 0, r.cut) for r in signal.cut_points(df, 4, 0.1, 3).collect()), []
    for s, v in by_series(rows).items():
        quiet = [sum(map(abs, v[k : k + 4])) / 4 < 0.1 for k in range(len(v) - 3)]
        want += [(s or 0, (a + b) // 2) for q, a, _, b in plain_runs(quiet) if q and b is not None and b - a > 3]
    assert got == sorted(want) and want


@pytest.fixture
def many_parts(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_with_a_hot_group(spark, many_parts):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), k, r.randrange(9), r.choice([None, None, "x", "y"])) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, k long, n long, v string").repartition(9)
    scans = {"before_n": ("sum", F.col("n")), "last_v": ("last", F.col("v")), "before_v": ("before", F.col("v")), "after_v": ("after", F.col("v"))}
    want = []
    for g in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: x[1])
        for i, x in enumerate(mine):
            values = [y[3] for y in mine]
            past, ahead = [v for v in values[:i] if v], [v for v in values[i + 1 :] if v]
            want.append((*x, sum(y[2] for y in mine[:i]), x[3] or (past[-1] if past else None), past[-1] if past else None, ahead[0] if ahead else None))
    for block in (None, F.expr("k div 50")):
        got = order.scanned(df, ["g"], ["k"], block, **scans)
        assert sorted(map(tuple, got.collect()), key=lambda x: x[1]) == sorted(want, key=lambda x: x[1])
    assert order.scanned(df.limit(0), ["g"], ["k"], **scans).count() == 0
    ranges = order._ranged(df.filter("g = 'a'"), "g", "k").select("range_").distinct().count()
    assert ranges > 1  # one group, several tasks


def test_sections_of_a_hot_group(spark, many_parts):
    rows = [("g" if k % 3 else "h", k, f"H{k}" if k % 50 == 7 else f"line {k}") for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, line string").repartition(7)
    got, now, want = {(r.g, r.k, r.section) for r in lexicon.sections(df, "g", ["k"], F.col("line").startswith("H"), "line").collect()}, {}, set()
    for g, k, line in rows:
        if line[0] == "H":
            now[g] = line
        else:
            want.add((g, k, now.get(g, "")))
    assert got == want


def test_spans_by_dyadic_cells(spark):
    r = random.Random(5)
    spans = [(r.randrange(3), k, a, a + r.choice([0, 1, 2, 7, 64, 300])) for k, a in enumerate(r.choices(range(-5, 400), k=200))]
    rows = [(s, k, float(k)) for s in range(4) for k in range(500)]
    got = signal.contained(spark.createDataFrame(rows, "series long, idx int, value double"), spark.createDataFrame(spans, "series long, span long, a long, b long"))
    assert sorted((x.series, x.span, x.idx) for x in got.collect()) == sorted((s, k, i) for s, k, a, b in spans for i in range(max(a, 0), min(b, 500)))
    wide = spark.createDataFrame([(3, 40_000_003), (0, 1), (5, 5), ((1 << 61) - 3, (1 << 61) + 12345)], "a long, b long").select("a", "b", signal.cells("a", "b").alias("c")).collect()
    for x in wide:
        covered = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in x.c)
        assert len(covered) < 60 and sum(e - s for s, e in covered) == max(0, x.b - x.a)
        assert not covered or (covered[0][0], covered[-1][1]) == (x.a, x.b)
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_parts_of_a_long_session(spark, many_parts):
    r = random.Random(1)
    rows = [("long" if k % 3 == 0 else f"s{k % 40}", k, r.choice([None, b"", bytes(r.randrange(256) for _ in range(r.randrange(1, 90)))])) for k in range(900)] + [(None, 1, b"n"), (None, 2, b"m")]
    df = spark.createDataFrame(rows, "session string, seq long, payload binary").repartition(11)
    made = sessions.parts(df, "session", ["seq"], "payload", 256)
    whole = {}
    for s, _, p in sorted(rows, key=lambda x: x[1]):
        whole.setdefault(s, []).append(p or b"")
    got = {}
    for x in sorted(made.collect(), key=lambda x: x.part):
        assert x.bytes == len(x.whole) < 256 + 90 and x.start == sum(len(p) for p in got.get(x.session, [])) and x.start // 256 == x.part
        got.setdefault(x.session, []).append(bytes(x.whole))
    assert {s: b"".join(p) for s, p in got.items()} == {s: b"".join(p) for s, p in whole.items()} and len(got["long"]) > 15
    import hashlib

    digests = {(x.session, x.digest, x.chunks, x.bytes) for x in sessions.digested(made, "session").collect()}
    assert digests == {(s, hashlib.md5(b"".join(p)).hexdigest(), len(p), sum(map(len, p))) for s, p in whole.items()}


def test_balance_goes_on_from_window_to_window(spark, many_parts):
    rows = [(k, r) for k, r in zip(range(100), random.Random(3).choices(range(-5, 9), k=100))]
    df = spark.createDataFrame([(k, max(n, 0), max(-n, 0)) for k, n in rows], "start_at long, came long, went long").repartition(5)
    total, want = 0, []
    for k, n in rows:
        total += n
        want.append((k, total, total < 20))
    assert [(x.start_at, x.balance, x.low) for x in sessions.balanced(df, 20).orderBy("start_at").collect()] == want


def test_cascade_goes_as_far_as_it_must(spark):
    """Words stay in order, rows fit the actual end and meet, silences part long rows, short groups stay."""
    from strandline.operators import segments

    long = " ".join(f"w{k}" for k in range(200))
    rows = [
        ("one", 0, 0, 100_000_000, long, [20_000_000, 45_000_000, 70_000_000], 100_300_000),  # no sentence ends: silences
        ("even", 0, 0, 100_000_000, long, None, 99_000_000),  # no silences: even parts, scaled
        ("said", 0, 0, 9_000_000, "First one. Second, longer one! And a third?", [1_000_000], None),
        ("kept", 0, 0, 2_000_000, "Too short. To split.", [1_000_000], 2_000_000),
        ("two", 0, 0, 5_000_000, "a. b.", None, None), ("two", 1, 4_000_000, 9_000_000, "c. d.", None, None), ("two", 2, 9_500_000, 12_000_000, "e", None, None),
        (None, 0, 0, 8_000_000, "", None, None),
    ]
    df = spark.createDataFrame(rows, "g string, seg_no long, s long, e long, text string, cuts array<long>, actual long").repartition(3)
    got = {}
    for r in sorted(segments.cascade(df, "g").collect(), key=lambda r: r.seg_no):
        got.setdefault(r.g, []).append((r.s, r.e, r.text))
    assert [x[:2] for x in got["one"]] == [(0, 20_000_000), (20_000_000, 45_000_000), (45_000_000, 70_000_000), (70_000_000, 100_300_000)]
    assert len(got["even"]) == 5 and got["even"][-1][1] == 99_000_000
    assert all(" ".join(t for *_, t in got[g]) == long for g in ("one", "even"))
    assert [t for *_, t in got["said"]] == ["First one.", "Second,", "longer one!", "And a third?"] and got["said"][-1][1] == 9_000_000
    assert got["kept"] == [(0, 2_000_000, "Too short. To split.")] and got[None] == [(0, 8_000_000, "")]
    assert [(s, e) for s, e, _ in got["two"]] == [(0, 4_500_000), (4_500_000, 9_000_000), (9_000_000, 12_000_000)]
    for rows in got.values():
        assert all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
