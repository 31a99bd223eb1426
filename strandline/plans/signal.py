"""Queries over signals and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import signal as G
from strandline.plans.base import Registry, table
from strandline.plans.segments import _REL, _SEG, relative_rows, segment_rows

R = Registry()
_S = "SELECT vec_id AS series, unnest(range(len(embedding)))::INT AS idx, unnest(embedding)::DOUBLE AS value FROM embeddings"


def _samples(spark, d):
    return G.samples(table(spark, d, "embeddings"), "vec_id", "embedding")


@R.add("A10_volume", f"SELECT series, idx // 16 AS frame, round(sqrt(avg(value * value)), 6) AS rms FROM ({_S}) GROUP BY 1, 2")
def volume(spark, d):
    return G.frame_volume(_samples(spark, d), 16).withColumn("rms", F.round("rms", 6))


@R.add("A11_threshold", f"""SELECT series, round(greatest(max(a) FILTER (r = floor(n / 5)), 0.15 * max(a) FILTER (r = floor(n / 2))), 6) AS threshold FROM (
    SELECT series, abs(value) AS a, row_number() OVER (PARTITION BY series ORDER BY abs(value)) - 1 AS r, count(*) OVER (PARTITION BY series) AS n FROM ({_S})) GROUP BY series""")
def threshold(spark, d):
    return G.adaptive_threshold(_samples(spark, d)).withColumn("threshold", F.round("threshold", 6))


@R.add("A12_mix", "SELECT label, idx, round(sum(value), 4) AS value FROM (SELECT label, unnest(range(len(embedding)))::INT AS idx, unnest(embedding)::DOUBLE AS value FROM embeddings) GROUP BY 1, 2")
def mix(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("series"), "label")
    return G.mixed(_samples(spark, d).join(labels, "series"), "label").withColumn("value", F.round("value", 4))


_FR = f"SELECT series, idx // 4 AS frame, sqrt(avg(value * value)) < 0.11 AS silent FROM ({_S}) GROUP BY 1, 2"


def _runs(src, place):
    return f"""SELECT *, lead(a) OVER (PARTITION BY series ORDER BY run) AS b FROM (SELECT series, run, silent, min({place}) AS a, count(*) AS n FROM (
      SELECT *, sum(new) OVER (PARTITION BY series ORDER BY {place}) AS run FROM (SELECT *, CASE WHEN lag(silent) OVER (PARTITION BY series ORDER BY {place}) IS NOT DISTINCT FROM silent THEN 0 ELSE 1 END AS new FROM ({src}))) GROUP BY series, run, silent)"""


@R.add("W05_voice", f"""SELECT series, row_number() OVER w - 1 AS seg_no, coalesce(lag(coalesce(b, total)) OVER w, 0)::INT AS a, a::INT AS b FROM (
    SELECT series, a, b, 16 AS total FROM ({_runs(_FR, 'frame')}) WHERE silent AND n >= 2 UNION ALL SELECT DISTINCT series, 16, NULL, 16 FROM ({_FR})) WINDOW w AS (PARTITION BY series ORDER BY a, b NULLS LAST)""")
def voice(spark, d):
    frames = G.frame_volume(_samples(spark, d), 4).select("series", "frame", (F.col("rms") < 0.11).alias("silent"))
    return G.voice_segments(frames, 2)


_HOPS = f"""SELECT series, idx, level < 0.1 AS silent FROM (SELECT *, avg(abs(value)) OVER w AS level, count(*) OVER w AS f FROM ({_S}) WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE f = 8 AND idx % 2 = 0"""


@R.add("W06_cuts", f"SELECT series, ((a + b) // 2)::BIGINT AS cut FROM ({_runs(_HOPS, 'idx')}) WHERE silent AND b IS NOT NULL AND b - a > 4")
def cuts(spark, d):
    return G.cut_points(_samples(spark, d), 8, 0.1, 4)


@R.add("W08_pairs", f"SELECT user_id, seg_no // 2 AS pair, max(s) FILTER (seg_no % 2 = 0) AS start_us, max(s) FILTER (seg_no % 2 = 1) AS end_us FROM ({_SEG}) WHERE seg_no // 2 * 2 + 1 < (SELECT 1000000000) GROUP BY 1, 2 HAVING count(*) = 2")
def pairs(spark, d):
    return G.paired(segment_rows(spark, d), "user_id", "s", "event_id").filter("end_us is not null")


@R.add("W09_complement", f"SELECT * FROM (SELECT user_id, lag(e, 1, 0) OVER (PARTITION BY user_id ORDER BY s, e) AS a, s AS b FROM ({_REL})) WHERE b > a")
def complement(spark, d):
    return G.complement(relative_rows(spark, d), "user_id")


@R.add("W13_timeline", "SELECT p_brand, p_partkey, coalesce(sum(p_size + 1) OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM part")
def timeline(spark, d):
    return G.timeline(table(spark, d, "part"), "p_brand", "p_size", "p_name", "p_partkey").select("p_brand", "p_partkey", "start")


_SPAN = "SELECT user_id AS series, event_id AS span, floor(value * 0.4)::BIGINT AS a, floor(value * 0.4)::BIGINT + 1 + event_id % 20 AS b FROM events WHERE 1 + event_id % 20 > 8"


@R.add("J10_contained", f"SELECT span, count(*) AS n, round(sum(value), 4) AS total FROM ({_S}) s JOIN ({_SPAN}) p ON p.series = s.series AND idx >= a AND idx < b GROUP BY span")
def contained(spark, d):
    a = F.floor(F.col("value") * 0.4).cast("long")
    spans = table(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("span"), a.alias("a"), (a + 1 + F.col("event_id") % 20).alias("b")).filter("b - a > 8")
    return G.contained(_samples(spark, d), spans).groupBy("span").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.add("R01_stereo", f"SELECT series, idx, value, unnest([0, 1]) AS channel FROM ({_S})")
def stereo(spark, d):
    return G.stereo(_samples(spark, d))


@R.add("R02_rate", f"SELECT series, ((idx * 24) // 64)::INT AS idx, round(avg(value), 6) AS value FROM ({_S}) GROUP BY 1, 2")
def rate(spark, d):
    return G.downsampled(_samples(spark, d), 64, 24).withColumn("value", F.round("value", 6))


@R.add("R03_chunks", "SELECT doc_id, k AS chunk_no, octet_length(c) AS size, md5(c) AS digest FROM (SELECT doc_id, k::INT AS k, unhex(substr(h, k * 2048 + 1, 2048)) AS c FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(greatest(1, ceil(octet_length(encode(text)) / 1024.0)::INT))) AS k FROM documents))")
def chunked(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(G.chunks(F.encode("text", "UTF-8"), 1024)).alias("c"))
    return rows.select("doc_id", "c.chunk_no", F.length("c.bytes").cast("long").alias("size"), F.md5("c.bytes").alias("digest"))


@R.add("R04_padding", f"SELECT series, idx, value FROM ({_S}) UNION ALL SELECT vec_id, unnest(range(len(embedding), len(embedding) + 16))::INT, 0.0::DOUBLE FROM embeddings")
def padding(spark, d):
    return G.silence_after(_samples(spark, d), 64, 0.25)


@R.add("U01_concat", f"SELECT series, (CASE WHEN series % 2 = 0 THEN 0 ELSE 1 END)::INT AS source, (coalesce(sum(n + 64) OVER (ORDER BY series % 2, series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM (SELECT vec_id AS series, len(embedding) AS n FROM embeddings)")
def concat(spark, d):
    lengths = table(spark, d, "embeddings").select(F.col("vec_id").alias("series"), F.size("embedding").alias("n"))
    both = lengths.filter("series % 2 = 0").withColumn("source", F.lit(0)).unionByName(lengths.filter("series % 2 <> 0").withColumn("source", F.lit(1)))
    return G.concatenated(both, "n", "source", "series", gap=64).select("series", "source", "start")
