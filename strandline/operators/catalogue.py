"""Operators of a catalogue job: groups, outcome counts, lookups, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.order import numbered


def grouped(items: DataFrame, group: str) -> DataFrame:
    """Groups with their size and their ordinal by key."""
    sizes = items.groupBy(group).agg(F.count("*").alias("n"))
    return numbered(sizes, "ordinal", group)


def outcomes(items: DataFrame, group: str, status: Column, started: str) -> DataFrame:
    """Counts of succeeded, failed and skipped rows with the time span, for each group and overall (null)."""
    out = items.withColumn("status_", status).rollup(group)
    return out.agg(
        F.count("*").alias("n"), F.count_if(F.col("status_") == "ok").alias("ok"), F.count_if(F.col("status_") == "failed").alias("failed"),
        F.count_if(F.col("status_") == "skipped").alias("skipped"), (F.max(started) - F.min(started)).alias("span"),
    )


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, name: str, default: str) -> DataFrame:
    """rows with the lookup's name for their key, or a default. Spark chooses the join by size."""
    return rows.join(lookup, key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def top(rows: DataFrame, key: str, most: int = 30) -> DataFrame:
    """The most frequent keys, ties by key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)


def bounded_sample(rows: DataFrame, key: str, *order: str, most: int = 200) -> DataFrame:
    """Counts of keys up to the row with which the `most`-th distinct key appears; then nothing counts.

    Only a row a key is ordered globally: its first appearance.
    """
    place = F.struct(*[F.col(c) for c in order])
    firsts = rows.groupBy(key).agg(F.min(place).alias("first"))
    last = firsts.orderBy("first").limit(most).agg(F.max("first").alias("last"), F.count("*").alias("held"))
    seen = rows.withColumn("place", place).crossJoin(F.broadcast(last))  # one row
    return seen.filter((F.col("held") < most) | (F.col("place") <= F.col("last"))).groupBy(key).agg(F.count("*").alias("n"))


def attached(items: DataFrame, pieces: DataFrame, key: str, missing: bool = False) -> DataFrame:
    """Items with the number of their pieces; items without any only if missing is set (then 0)."""
    n = pieces.groupBy(key).agg(F.count("*").alias("pieces"))
    return items.join(n, key, "left" if missing else "inner").withColumn("pieces", F.coalesce("pieces", F.lit(0)))
