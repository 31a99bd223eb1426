"""Operators over sampled signals in long form: (series, idx, value), and over intervals of time.

A long series is cut into blocks of BLOCK places, so that it is many tasks: windows go over a block, with
as many samples of the next as they need, and what goes on from block to block is carried by a row a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.order import running, scanned
from strandline.sources.folders import scratch

#: Places of a series that one task puts in order.
BLOCK = 1 << 16
#: Bins of a histogram, and rows of a bin that are few enough to be sorted.
BINS, FEW = 1024, 4096


def samples(df: DataFrame, series: str, array: str) -> DataFrame:
    return df.select(F.col(series).alias("series"), F.posexplode(array).alias("idx", "value")).withColumn("value", F.col("value").cast("double"))


def frame_volume(rows: DataFrame, frame: int = 1024) -> DataFrame:
    """Root mean square of each frame."""
    return rows.groupBy("series", F.expr(f"idx div {frame}").cast("int").alias("frame")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def ranked(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """A row for each group: the values at places (from 0) of its values in ascending order; ranks: their
    names, and expressions of n, the number of values. Null where a group has no such place.

    Selection by histograms: a group's range is cut into bins, by logarithm first, then evenly. Only the bin
    that holds the place is kept, with its least and greatest value, and cut again until it has few rows or
    one value, or cannot be cut. Nothing is sorted but what is left then. Null and NaN take no part, and
    infinite values count as the largest numbers.
    """
    most = 1.7976931348623157e308
    v = F.greatest(F.lit(-most), F.least(F.lit(most), F.col(value).cast("double")))
    rows = rows.select(F.col(group).alias("group_"), v.alias("v"), F.col(value).alias("given_")).filter("given_ is not null and not isnan(given_)").drop("given_")
    of = rows.groupBy("group_").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])).alias("w")
    ends = of.select("group_", "n", "low", "high", wanted).select("group_", "w.name", "w.rank", "n", "low", "high", F.lit(False).alias("stuck")).filter("rank between 0 and n - 1")
    log, done = True, None
    ends = _kept(ends, "ranks")
    while True:
        final = ends.filter("low = high").select("group_", "name", F.col("low").alias("value"))
        small = ends.filter(f"low < high and (n <= {FEW} or stuck)")
        place = F.row_number().over(Window.partitionBy("group_", "name").orderBy("v")) - 1
        sorted_ = _within(rows, small).withColumn("place", place).filter("place = rank").select("group_", "name", F.col("v").alias("value"))
        done = final.unionByName(sorted_) if done is None else done.unionByName(final).unionByName(sorted_)
        open_ = ends.filter(f"low < high and n > {FEW} and not stuck")
        if open_.isEmpty():
            break
        up, all_ = F.col("v") / 4 - F.col("low") / 4, F.col("high") / 4 - F.col("low") / 4  # quarters: no overflow
        away = F.try_divide(F.log1p(up), F.log1p(all_)) if log else F.try_divide(up, all_)
        bins = _within(rows, open_).withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.coalesce(away, F.lit(0.0)) * BINS)))
        bins = bins.groupBy("group_", "name", "rank", "n", "low", "high", "bin").agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy("group_", "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = bins.withColumn("before", before).filter("rank >= before and rank < before + m")
        ends = _kept(kept.select("group_", "name", (F.col("rank") - F.col("before")).alias("rank"), F.col("m").alias("n"), F.col("least").alias("low"), F.col("most").alias("high"), ((F.col("m") == F.col("n")) & F.lit(not log)).alias("stuck")), "ranks")
        log = False
    found = done.groupBy("group_").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks])
    every = of.select(F.col("group_").alias(group)).join(found, F.col(group).eqNullSafe(F.col("group_")), "left")
    return every.select(group, *ranks)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _within(rows: DataFrame, ends: DataFrame) -> DataFrame:
    e = ends.withColumnRenamed("group_", "g")
    return rows.join(e, F.col("group_").eqNullSafe(F.col("g")) & F.col("v").between(F.col("low"), F.col("high"))).drop("g")


def adaptive_threshold(rows: DataFrame) -> DataFrame:
    """max(value at rank n/5, 0.15 * value at rank n/2) of the absolute values, ranks from 0; 0.01 if none."""
    at = ranked(rows.select("series", F.abs("value").alias("a")), "series", "a", {"fifth": F.floor(F.col("n") / 5), "half": F.floor(F.col("n") / 2)})
    made = at.select("series", F.greatest(F.col("fifth"), 0.15 * F.col("half")).alias("threshold"))
    none = rows.groupBy("series").agg(F.count("value").alias("n")).filter("n = 0").select("series", F.lit(0.01).alias("threshold"))
    return made.unionByName(none)


def mixed(rows: DataFrame, group: str) -> DataFrame:
    """Sample-wise sum of a group's series; as long as the longest."""
    return rows.groupBy(group, "idx").agg(F.sum("value").alias("value"))


def runs(frames: DataFrame, place: str, silent: str, block: int = BLOCK) -> DataFrame:
    """Runs of equal `silent` in order of place: series, run (from 1), silent, a, n (frames), first place after it.

    Runs are counted within blocks of places. A block's first run goes on with the last of the block before
    it if both are alike, and its number follows from those of the blocks before.
    """
    of = ("series", "block_")
    w = Window.partitionBy(*of).orderBy(place)
    rows = frames.select("series", place, silent, F.expr(f"cast({place} as bigint) div {block}").alias("block_"))
    rows = rows.withColumn("new_", F.coalesce((~F.lag(silent).over(w).eqNullSafe(F.col(silent))).cast("int"), F.lit(1)))
    rows = rows.withColumn("part_", F.sum(F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("new_"))).over(w))
    parts = rows.groupBy(*of, "part_", silent).agg(F.min(place).alias("a"), F.count("*").alias("n"))
    edges = parts.groupBy(*of).agg(F.min_by(silent, "part_").alias("first_"), F.max_by(silent, "part_").alias("last_"), (F.max("part_") + 1).alias("parts_"))
    next_ = Window.partitionBy("series").orderBy("block_")  # a row a block
    joined = (F.lag("block_").over(next_).isNotNull() & F.lag("last_").over(next_).eqNullSafe(F.col("first_"))).cast("long")
    edges = edges.withColumn("on_", joined)
    before = F.coalesce(F.sum(F.col("parts_") - F.col("on_")).over(next_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(F.col("series").alias("s_"), F.col("block_").alias("b_"), (before - F.col("on_") + 1).alias("base_"))
    numbered = parts.join(edges, F.col("series").eqNullSafe(F.col("s_")) & (F.col("block_") == F.col("b_")))
    out = numbered.groupBy("series", (F.col("base_") + F.col("part_")).alias("run"), silent).agg(F.min("a").alias("a"), F.sum("n").alias("n"))
    after = out.select(F.col("series").alias("s_"), (F.col("run") - 1).alias("r_"), F.col("a").alias("b"))
    return out.join(after, F.col("series").eqNullSafe(F.col("s_")) & (F.col("run") == F.col("r_")), "left").drop("s_", "r_")


def voice_segments(frames: DataFrame, least: int) -> DataFrame:
    """Segments (series, seg_no, a, b) of frames (series, frame, silent) between silences of `least` frames.

    A segment closes where such a silence starts; the next begins with the first loud frame after it.
    Shorter silences are bridged. The tail is always given (empty after a last long silence), and
    leading silence gives an empty first segment.
    """
    total = frames.groupBy("series").agg((F.max("frame") + 1).alias("total"))
    long = runs(frames, "frame", "silent", BLOCK).filter(F.col("silent") & (F.col("n") >= least)).select("series", "a", "b")
    edges = long.select("*", F.lit(0).alias("tail")).unionByName(total.select("series", F.col("total").alias("a"), F.col("total").alias("b"), F.lit(1).alias("tail")))
    totals = total.select(F.col("series").alias("s_"), "total")
    edges = edges.join(totals, F.col("series").eqNullSafe(F.col("s_"))).drop("s_").withColumn("b", F.coalesce("b", "total"))
    cut = F.expr(f"cast(a as bigint) div {BLOCK}")
    rows = scanned(edges, ["series"], ["a", "tail"], cut, seg_no=("sum", F.lit(1)), start=("before", F.col("b")))
    return rows.select("series", F.col("seg_no").cast("long").alias("seg_no"), F.coalesce("start", F.lit(0)).cast("int").alias("a"), F.col("a").cast("int").alias("b"))


def cut_points(rows: DataFrame, window: int, threshold: float, least: int) -> DataFrame:
    """Middles of silences: hops of window / 4 whose mean absolute value stays under the threshold for
    more than `least` samples. A silence that reaches the end gives none.

    A block takes the first window - 1 samples of the next with it.
    """
    hop, block = max(1, window // 4), max(BLOCK, 4 * window)
    own = F.expr(f"cast(idx as bigint) div {block}")
    halo = (F.col("idx") % block < window - 1) & (own > 0)
    dealt = rows.select("series", "idx", "value", own.alias("own_"), F.explode(F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))).alias("block_"))
    w = Window.partitionBy("series", "block_").orderBy("idx").rowsBetween(0, window - 1)
    level = dealt.withColumns({"level": F.avg(F.abs("value")).over(w), "full": F.count("*").over(w)}).filter("own_ = block_")
    hops = level.filter((F.col("full") == window) & (F.col("idx") % hop == 0)).select("series", "idx", (F.col("level") < threshold).alias("silent"))
    found = runs(hops, "idx", "silent", block).filter(F.col("silent") & F.col("b").isNotNull() & (F.col("b") - F.col("a") > least))
    return found.select("series", F.expr("(a + b) div 2").alias("cut"))


def paired(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows taken two by two: start_us of the first, end_us of the second (null if it lacks)."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = rows.withColumn("r", F.row_number().over(w) - 1)
    at = lambda k: F.max(F.when(F.col("r") % 2 == k, F.col("s")))
    return rows.groupBy(group, F.floor(F.col("r") / 2).alias("pair")).agg(at(0).alias("start_us"), at(1).alias("end_us"))


def complement(rows: DataFrame, group: str, emit_tail: bool = False, end: str | None = None) -> DataFrame:
    """What lies between intervals (s, e): from 0 or the end before to each start, if positive.

    What follows the last interval is given only with emit_tail, up to column `end`.
    """
    w = Window.partitionBy(group).orderBy("s", "e")
    out = rows.select(group, F.lag("e", 1, 0).over(w).alias("a"), F.col("s").alias("b"))
    if emit_tail:
        out = out.unionByName(rows.groupBy(group).agg(F.max("e").alias("a"), F.max(end).alias("b")))
    return out.filter("b > a")


def timeline(items: DataFrame, group: str, length: str, *order: str, gap: int = 1) -> DataFrame:
    """Adds start: a group's items one after another, with a gap after each, the last included."""
    return scanned(items, [group], list(order), start=("sum", (F.col(length) + gap).cast("long")))


def concatenated(items: DataFrame, length: str, *order: str, gap: int = 1) -> DataFrame:
    """Adds start, as timeline() does, over all items as one group."""
    return running(items, (F.col(length) + gap).cast("long"), "start", *order)


def cells(a: str, b: str) -> Column:
    """The dyadic cells (level, cell) that make up [a, b), columns of longs from 0 on: at most two of each
    level. Cell c of level k holds the places from c * 2^k to (c + 1) * 2^k - 1. At each level what is left is
    [low, high); an odd low and, below an odd high, high - 1 are cells of it, and half of what remains goes up."""
    low = f"shiftright(cast({a} as bigint) + shiftleft(1L, k) - 1L, k)"
    high = f"shiftright(cast({b} as bigint), k)"
    taken = f"filter(array(if({low} < {high} and {low} % 2 = 1, {low}, null), if({low} < {high} and {high} % 2 = 1, {high} - 1L, null)), c -> c is not null)"
    return F.expr(f"flatten(transform(sequence(0, cast(log2(greatest(1, {b} - {a})) as int) + 1), k -> transform({taken}, c -> struct(k as level, c as cell))))")


def contained(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Samples within spans (series, span, a, b), a <= idx < b: an equi-join on dyadic cells.

    A span is at most two cells a level, whatever its length, and no two of them overlap, so a sample and a
    span meet once. A sample looks up one cell for each level that its series' spans have.
    """
    zero = F.greatest(F.col("a").cast("long"), F.lit(0))
    cut = spans.filter("b > a and b > 0").withColumn("from_", zero).withColumn("c_", F.explode(cells("from_", "b"))).select(*spans.columns, "c_.level", "c_.cell")
    levels = cut.groupBy("series").agg(F.collect_set("level").alias("levels_"))  # at most 62
    looked = rows.join(levels, "series").withColumn("level", F.explode("levels_")).withColumn("cell", F.expr("shiftright(cast(idx as bigint), level)")).drop("levels_")
    return looked.join(cut, ["series", "level", "cell"]).drop("level", "cell")


def stereo(rows: DataFrame) -> DataFrame:
    """One channel as two."""
    return rows.withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1))))


def downsampled(rows: DataFrame, source: int, target: int) -> DataFrame:
    """Means over buckets of the lower rate."""
    return rows.groupBy("series", F.expr(f"(idx * {target}) div {source}").cast("int").alias("idx")).agg(F.avg("value").alias("value"))


def silence_after(rows: DataFrame, rate: int, seconds: float) -> DataFrame:
    """Each series followed by zeros."""
    n = int(rate * seconds)
    ends = rows.groupBy("series").agg(F.max("idx").alias("last"))
    zeros = ends.select("series", F.explode(F.sequence(F.col("last") + 1, F.col("last") + n)).alias("idx"), F.lit(0.0).alias("value"))
    return rows.select("series", "idx", "value").unionByName(zeros)


def chunks(c, size: int):
    """A byte string in pieces of `size` bytes: array of (chunk_no, bytes)."""
    n = F.greatest(F.lit(0), F.ceil(F.length(c) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.alias("chunk_no"), F.substring(c, k * size + 1, F.lit(size)).alias("bytes")))
