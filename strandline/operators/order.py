"""Running numbers, sums and last values over large groups, without one task that sees all of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.folders import scratch


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """df dealt into ranges of order, with their number in range_; written, so that a lost executor can't deal them anew."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "ranges")
    dealt = df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def scanned(df: DataFrame, group: list[str], order: list[str], block: Column | None = None, **made: tuple[str, Column]) -> DataFrame:
    """Adds columns, each a kind of scan and a value, over the rows of a group in the order of columns `order`:

    sum: the values of the rows before, added up (0 for the first)
    last: the last value that is not null, up to the row
    before: the last value that is not null, before the row
    after: the first value that is not null, after the row

    Rows are scanned within blocks, and a block's carry comes from the blocks of its group before it (or
    after it), a row a block. Blocks are ranges of (group, order), or what `block` says, which must not fall
    as order rises. The columns of order have to tell a group's rows apart, or ties are ordered at will.
    """
    rows = df.withColumns({f"v_{name}": value for name, (_, value) in made.items()})
    rows = rows.withColumn("range_", block) if block is not None else _ranged(rows, *group, *order)
    within = Window.partitionBy("range_", *group).orderBy(*order)
    across = Window.partitionBy(*group).orderBy("range_") if group else Window.orderBy("range_")
    up, past, ahead = (0, 0), (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    place, local, summary, carry, out = F.struct(*order), {}, [], [], []
    for name, (kind, _) in made.items():
        v, s = F.col(f"v_{name}"), F.col(f"s_{name}")
        at = F.when(v.isNotNull(), place)
        if kind == "sum":
            local[f"l_{name}"] = F.coalesce(F.sum(v).over(within.rowsBetween(*past)), F.lit(0))
            summary.append(F.sum(v).alias(f"s_{name}"))
            carry.append(F.coalesce(F.sum(s).over(across.rowsBetween(*past)), F.lit(0)).alias(f"c_{name}"))
            out.append((F.col(f"l_{name}") + F.col(f"c_{name}")).alias(name))
            continue
        if kind in ("last", "before"):
            frame = (past[0], up[1]) if kind == "last" else past
            local[f"l_{name}"] = F.last(v, ignorenulls=True).over(within.rowsBetween(*frame))
            summary.append(F.max_by(v, at).alias(f"s_{name}"))
            carry.append(F.last(s, ignorenulls=True).over(across.rowsBetween(*past)).alias(f"c_{name}"))
        elif kind == "after":
            local[f"l_{name}"] = F.first(v, ignorenulls=True).over(within.rowsBetween(*ahead))
            summary.append(F.min_by(v, at).alias(f"s_{name}"))
            carry.append(F.first(s, ignorenulls=True).over(across.rowsBetween(*ahead)).alias(f"c_{name}"))
        else:
            raise ValueError(f"no such scan: {kind}")
        out.append(F.coalesce(f"l_{name}", f"c_{name}").alias(name))
    keys = ["range_", *group]
    carried = rows.groupBy(*keys).agg(*summary).select(*[F.col(k).alias(f"k_{k}") for k in keys], *carry)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
    return rows.withColumns(local).join(carried, same).select(*df.columns, *out)


def unrolled(df: DataFrame, keep: list, array: Column, place: str, name: str) -> DataFrame:
    """A row for each element of array, with its place from 0, and the columns `keep`.

    An inner explode makes Spark filter rows by the array's size first, so that the array is made twice, and
    the first time wherever that filter can be pushed, which may be below a shuffle, where few tasks run.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(place, name)).filter(F.col(place).isNotNull())


def running(df: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """Adds `name`: the sum of value over all rows before a row in the order of columns `order` (0 for the first)."""
    return scanned(df, [], list(order), **{name: ("sum", value)})


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds `name`: a row's number in the order of columns `order`, from 1."""
    return running(df, F.lit(1), "before_", *order).withColumn(name, F.col("before_") + 1).drop("before_")
