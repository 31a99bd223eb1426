"""Sinks: segment manifests, lines, partitioned outputs, vocabularies, reports, assembled streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_json(segments: DataFrame, group: str) -> DataFrame:
    """One JSON array of (index from 1, text, begin, end, file) for each group."""
    one = F.struct((F.col("seg_no") + 1).alias("index"), "text", F.col("s").alias("begin"), F.col("e").alias("end"), "file")
    return segments.groupBy(group).agg(F.to_json(F.sort_array(F.collect_list(one))).alias("manifest"))


def lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet folders by key. Rows meet by key and a salt first, so that a large key has several files."""
    df.repartition(*[F.col(k) for k in keys], F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(4))).write.partitionBy(*keys).parquet(path)


def vocabulary(df: DataFrame, path: str) -> None:
    """CSV with a header: book, section, word, meaning."""
    df.select(F.col("book").alias("BookName"), F.col("section").alias("CatalogueName"), F.col("word").alias("WordText"), F.col("meaning").alias("TranslateText")).write.option("header", True).option("escape", '"').csv(path)


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_each_batch(stream: DataFrame, path: str, checkpoint: str):
    """A stream's rows into Parquet, a batch at a time: a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
