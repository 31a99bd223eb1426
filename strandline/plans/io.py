"""Queries of sources and sinks: what is written from the tables is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text
from strandline.plans.base import Registry, table
from strandline.plans.scalars import _LINES, _SENTENCES, line_rows, sentence_rows
from strandline.plans.streams import _EV, frame_rows
from strandline.sources import readers, writers
from strandline.sources.folders import scratch
from strandline.streaming import frames as X
from strandline.streaming import live as V
from strandline.streaming import sessions as Z

R = Registry()


def _through_manifest(spark, rows):
    """Rows written as a manifest and read back; line ends and backslashes are escaped in the file."""
    path = scratch(spark, "manifest")
    for old, new in (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r")):
        rows = rows.withColumn("content", F.replace("content", F.lit(old), F.lit(new)))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = readers.manifest(spark, path)
    for old, new in (("\\n", "\n"), ("\\r", "\r"), ("\\s", "\\")):
        back = back.withColumn("content", F.replace("content", F.lit(old), F.lit(new)))
    return back


@R.add("S01_documents", "SELECT doc_id::INT AS id, (doc_id % 7)::INT AS catalogue_id, source AS audio_url, text AS content FROM documents")
def manifest_documents(spark, d):
    """Whole texts of all documents through the manifest."""
    return _through_manifest(spark, table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("id"), (F.col("doc_id") % 7).cast("int").alias("catalogue_id"), F.col("text").alias("content"), F.col("source").alias("audio_url")))


@R.add("S02_whole_texts", f"SELECT sum(length(line) + 1)::BIGINT AS chars FROM ({_LINES})")
def whole_texts(spark, d):
    path = scratch(spark, "texts")
    writers.lines(line_rows(spark, d), "line", path)
    return readers.whole_texts(spark, path).agg(F.sum(F.length("value")).alias("chars"))


@R.add("S03_alignment", "SELECT event_id AS id, 0 AS fragment_no, value AS begin_s, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value + 1 END AS end_s, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS text FROM events WHERE event_id % 11 <> 0")
def alignment(spark, d):
    e = table(spark, d, "events")
    end = F.when(F.col("event_id") % 3 == 0, "bad").otherwise((F.col("value") + 1).cast("string"))
    lines = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type", F.lit("more")))
    one = F.array(F.struct(F.col("value").cast("string").alias("begin"), end.alias("end"), lines.alias("lines")))
    path = scratch(spark, "alignment")
    e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 != 0, one).alias("fragments")).write.json(path)
    return readers.fragments(spark, path)


@R.add("S04_listing")
def listing(spark, d):
    """Files of a supported kind in a folder written from the lines of the documents."""
    path = scratch(spark, "listing")
    writers.lines(line_rows(spark, d).repartition(8, "doc_id"), "line", path)
    return readers.files(spark, path, extensions=(".txt",)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@R.add("S05_blobs", f"SELECT sum(octet_length(encode(line)) + 1)::BIGINT AS bytes FROM ({_LINES})")
def blobs(spark, d):
    path = scratch(spark, "blobs")
    writers.lines(line_rows(spark, d), "line", path)
    return readers.blobs(spark, path).filter("path like '%.txt'").agg(F.sum(F.length("content")).cast("long").alias("bytes"))


@R.add("S07_silence_log", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS type, round(value, 3) AS time_s FROM events WHERE event_id % 10 <> 9")
def silence_log(spark, d):
    mark = F.concat(F.when(F.col("event_id") % 2 == 0, "silence_start: ").otherwise("silence_end: "), F.round("value", 3).cast("decimal(18,3)").cast("string"))
    line = F.concat(F.lit("[detect @ "), F.col("event_id").cast("string"), F.lit("] "), F.when(F.col("event_id") % 10 == 9, "size=0").otherwise(mark))
    path = scratch(spark, "log")
    writers.lines(table(spark, d, "events").select(line.alias("line")), "line", path)
    rows = readers.silence_events(spark.read.text(path))
    return rows.select(F.regexp_extract("value", r"@ (\d+)\]", 1).cast("long").alias("event_id"), "type", "time_s")


def _frames(spark, d):
    path = scratch(spark, "frames")
    frame_rows(spark, d).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return X.frame_stream(spark, path)


@R.add("S08_frame_stream", f"SELECT code AS event, count(*) AS n, count(*) FILTER (event_id % 50 <> 0) AS whole FROM ({_EV}) GROUP BY code")
def frame_stream(spark, d):
    """Frames as a stream, decoded and appended by batches, then counted."""
    path = scratch(spark, "decoded")
    rows = X.decoded(_frames(spark, d)).select("event", "reason")
    writers.append_each_batch(rows, path, scratch(spark, "stream")).awaitTermination()
    return spark.read.parquet(path).groupBy("event").agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("whole"))


_ENDED = f"""WITH f AS (SELECT user_id::VARCHAR AS session, event_id, ts, code, props, event_id % 50 = 0 AS cut FROM ({_EV})),
    e AS (SELECT session, min(struct_pack(ts, event_id)) AS at, arg_min(code, struct_pack(ts, event_id)) AS code FROM f WHERE code IN (152, 52, 51, 153) GROUP BY session)
    SELECT e.session, CASE WHEN e.code IN (152, 52) THEN 'ended' ELSE 'failed' END AS state, count(props) AS chunks, coalesce(sum(octet_length(encode(props))), 0)::BIGINT AS bytes, md5(coalesce(string_agg(props, '' ORDER BY event_id), '')) AS digest
    FROM e LEFT JOIN f ON f.session = e.session AND f.code = 352 AND NOT f.cut AND (f.ts, f.event_id) < (e.at.ts, e.at.event_id) GROUP BY e.session, e.code"""


@R.add("S12_assembly_stream", _ENDED)
def assembly_stream(spark, d):
    """Sessions until their end event: chunks leave the stream's state, parts are made of them in order."""
    path = scratch(spark, "chunks")
    V.replayed(frame_rows(spark, d), "ts", lambda rows, c: V.to_table(path)(V.pieces(X.decoded(rows).select("session", "seq", "ts", "event", "payload")), c))
    rows = spark.read.parquet(path)
    ended = rows.filter("seq is null").select("session", "state")
    made = Z.digested(Z.parts(rows.filter("seq is not null"), "session", ["seq"], "payload"), "session")
    met = ended.join(made.withColumnRenamed("session", "s"), F.col("session").eqNullSafe(F.col("s")), "left")
    return met.select("session", "state", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("digest", F.md5(F.lit(""))).alias("digest"))


@R.add("S09_manifest_json", f"SELECT doc_id, count(*) AS n, min(seg_no + 1) AS first, max(seg_no + 1) AS last, sum(length(text))::BIGINT AS chars FROM ({_SENTENCES}) GROUP BY doc_id")
def manifest_json(spark, d):
    rows = sentence_rows(spark, d).withColumns({"s": F.col("seg_no"), "e": F.col("seg_no") + 1, "file": F.format_string("%03d_%s.wav", (F.col("seg_no") + 1), text.file_name(F.col("text")))})
    path = scratch(spark, "json")
    writers.report(writers.manifest_json(rows, "doc_id"), path)
    back = spark.read.schema("doc_id long, manifest string").json(path)
    one = F.explode(F.from_json("manifest", "array<struct<index:long,text:string,begin:long,end:long,file:string>>"))
    return back.select("doc_id", one.alias("m")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("m.index").alias("first"), F.max("m.index").alias("last"), F.sum(F.length("m.text")).alias("chars"))


@R.add("S10_lines", f"SELECT line AS value, count(*) AS n FROM ({_LINES}) GROUP BY 1")
def lines(spark, d):
    path = scratch(spark, "lines")
    writers.lines(line_rows(spark, d), "line", path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@R.add("S11_partitioned", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1, 2")
def partitioned(spark, d):
    path = scratch(spark, "orders")
    writers.partitioned(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, "o_orderstatus", "o_orderpriority")
    return spark.read.parquet(path).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@R.add("S13_vocabulary", f"SELECT section, count(*) AS n, count(DISTINCT word) AS words FROM (SELECT doc_id % 7 AS section, string_split(line, ' ')[1] AS word FROM ({_LINES})) WHERE word <> '' GROUP BY section")
def vocabulary(spark, d):
    head, rest = text.head_rest(F.col("line"))
    path = scratch(spark, "vocabulary")
    rows = line_rows(spark, d).select(F.lit("book").alias("book"), (F.col("doc_id") % 7).alias("section"), head.alias("word"), rest.alias("meaning")).filter("word <> ''")
    writers.vocabulary(rows, path)
    back = spark.read.schema("BookName string, CatalogueName long, WordText string, TranslateText string").option("header", True).option("escape", '"').csv(path)
    return back.groupBy(F.col("CatalogueName").alias("section")).agg(F.count("*").alias("n"), F.countDistinct("WordText").alias("words"))


@R.add("S14_report", "SELECT o_orderkey, o_orderstatus = 'F' AS success, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'not finished' END AS error FROM orders")
def report(spark, d):
    done = F.col("o_orderstatus") == "F"
    path = scratch(spark, "report")
    writers.report(table(spark, d, "orders").select("o_orderkey", done.alias("success"), F.when(~done, "not finished").alias("error")), path)
    return spark.read.schema("o_orderkey long, success boolean, error string").json(path)
