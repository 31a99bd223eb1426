"""Operator 3: mixing sources to target weights, with DataFrame functions only.

Sources get target numbers of words: shares by weight, none above `most` times its own size, the
excess going to the others by weight. A source's words are taken in complete epochs first. For the
fraction left, its documents stand in the order of exponential keys (Efraimidis and Spirakis): minus
the logarithm of a uniform number, divided by the document's quality weight, smallest first. The
prefix sum of their words fills the budget; the document at its edge is taken if that comes nearer.

Weights have ten levels, so a key's distribution function within its source is known from ten counts.
It deals a source into buckets of about ROWS_EACH rows in key order: prefix sums go over buckets, then
within each, so that no task has to hold a large source.

Defined results: null text has size 0 and is taken 0 times its words; null sources are one source,
the last; null or repeated doc_ids have keys of their own by their texts, and only equal rows tie, of
which either may be taken; if all sizes are 0, all targets are 0; further columns are kept, those named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import common

LEVELS = 10
ROWS_EACH = 4000


def sized(docs: DataFrame) -> DataFrame:
    """Adds size (words), level, the quality weight in tenths from 1 to 10, and mark, a digest of the text.

    The weight falls as the mean length of words departs from six characters.
    """
    text = common.text_or_empty()
    out = docs.withColumn("size", F.regexp_count(text, F.lit(common.WORD)).cast("long"))
    far = F.abs(F.length(text) / F.greatest(F.col("size"), F.lit(1)) - F.lit(7.0)) / F.lit(14.0)
    return out.withColumn("level", F.greatest(F.lit(1), LEVELS - F.floor(F.least(F.lit(1.0), far) * LEVELS)).cast("int")).withColumn("mark", F.md5(text.cast("binary")))


def targets(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """A row for each source: its size, rows of each level, target.

    With sources by cap over weight ascending, let f be, at each, what the ones before leave over
    for it and the rest, by weight. f rises up to the first source that is not capped and falls
    after it, so its maximum is the level of filling.
    """
    n = [F.count_if(F.col("level") == k).alias(f"n{k}") for k in range(1, LEVELS + 1)]
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"), *n)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("place_", place.cast("int")).withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    fill = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("fill", fill).withColumn("fill", F.max("fill").over(every))
    return by.withColumn("target", F.least("cap", F.col("fill") * F.col("weight"))).drop("weight", "cap", "fill")


def _uniform(doc_id: Column, mark: Column, seed: int) -> Column:
    """A number in (0, 1) from a document's id and text: 52 bits of a digest. Null or repeated ids part by their texts."""
    hexed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), mark).cast("binary"))
    return (F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(rows: DataFrame, seed: int = 7, **shares) -> DataFrame:
    """rows as sized() leaves them, with source_size, target, times (whole copies) and taken (words).

    The other columns travel in one of their own, so none clashes with those that are made on the way.
    """
    kept = F.struct(*[c for c in rows.columns if c not in ("source_size", "target", "times", "taken", "mark")]).alias("kept")
    rows = rows.select("doc_id", "source", "size", "level", "mark", kept)
    rows = rows.withColumn("key", -F.log(_uniform(F.col("doc_id"), F.col("mark"), seed)) * LEVELS / F.col("level"))
    by = targets(rows, **shares).withColumnRenamed("source", "s")
    rows = rows.join(by, F.col("source").eqNullSafe(F.col("s")))
    above = sum((F.col(f"n{k}") * F.exp(-F.col("key") * (k / LEVELS)) for k in range(2, LEVELS + 1)), F.col("n1") * F.exp(-F.col("key") / LEVELS))
    buckets = F.ceil(F.col("source_rows") / ROWS_EACH)
    bucket = F.least(buckets - 1, F.floor((1 - above / F.col("source_rows")) * buckets)).cast("long")
    rows = rows.withColumn("bucket", bucket).drop("s", "source_rows", *[f"n{k}" for k in range(1, LEVELS + 1)])
    # place_ stands for the source, null too, so that the join and the window need one shuffle of the rows
    sums = rows.groupBy("place_", "bucket").agg(F.sum("size").alias("bucket_size"))
    base = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("place_").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums.select("place_", "bucket", base.alias("base")), ["place_", "bucket"])
    running = F.sum("size").over(Window.partitionBy("place_", "bucket").orderBy("key", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("base") + running - F.col("size") / 2
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    times = epochs + F.when((middle <= rest) & (rest > 0), 1).otherwise(0)
    rows = rows.withColumn("times", times.cast("long")).withColumn("taken", F.col("times") * F.col("size"))
    return rows.select("kept.*", "source_size", "target", "times", "taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: how many words the mix takes of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = common.written(sized(docs).select("doc_id", "source", "size", "level", "mark"), "sizes")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken", "times")


SQL = r"""
WITH a AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS mark
  FROM documents),
b AS (
  SELECT doc_id, source, size, mark,
         greatest(1, 10 - floor(least(1.0::DOUBLE, abs(length(t)::DOUBLE / greatest(size, 1) - 7.0::DOUBLE) / 14.0::DOUBLE) * 10))::INT AS level
  FROM a),
k AS (
  SELECT *, -ln((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || mark), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) * 10 / level AS key
  FROM b),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM b GROUP BY source),
w AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
f AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill
  FROM w),
g AS (SELECT source, source_size, least(cap, (SELECT max(fill) FROM f) * weight) AS target FROM f),
m AS (
  SELECT k.doc_id, k.size, g.source_size, g.target,
         (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.mark ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - k.size::DOUBLE / 2 AS middle,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
r AS (
  SELECT *, (epochs + CASE WHEN middle <= target - epochs * source_size AND target - epochs * source_size > 0 THEN 1 ELSE 0 END)::BIGINT AS times FROM m)
SELECT doc_id, size::BIGINT AS size, source_size, target, times * size::BIGINT AS taken, times FROM r
"""
