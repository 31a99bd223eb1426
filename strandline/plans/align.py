"""Queries that align texts with segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import align as A
from strandline.plans.base import Registry, documents, table
from strandline.plans.scalars import _LINES, _NORM, _RATIO, _SENTENCES, line_rows, sentence_rows
from strandline.plans.segments import _SEG, segment_rows

R = Registry()
_TURNS = "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seg_no, text FROM conversations"
_WORDS = f"list_filter(string_split({_NORM}, ' '), lambda x: length(x) > 0)"


def _spread(src: str, key: str, n: str) -> str:
    """SQL: words w of src over n segments."""
    return f"""SELECT {key}, k AS seg_no, array_to_string(w[k * per + 1 : CASE WHEN k = n - 1 THEN len(w) ELSE (k + 1) * per END], ' ') AS text FROM (
      SELECT *, unnest(range(least(n, ceil(len(w)::DOUBLE / per)::INT)))::INT AS k FROM (SELECT {key}, w, n, greatest(1, len(w) // n)::INT AS per FROM (SELECT {key}, w, {n} AS n FROM ({src})) WHERE len(w) > 0 AND n > 0))"""


def turn_rows(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.row_number().over(w) - 1).cast("long").alias("seg_no"), F.col("text"))


@R.add("J05_zip", f"""SELECT l.doc_id, l.seg_no, l.line, t.text AS said, a.n <> b.n AS uneven FROM (SELECT doc_id, line_no AS seg_no, line FROM ({_LINES})) l JOIN ({_TURNS}) t USING (doc_id, seg_no)
    JOIN (SELECT doc_id, count(*) AS n FROM ({_LINES}) GROUP BY 1) a ON a.doc_id = l.doc_id JOIN (SELECT doc_id, count(*) AS n FROM ({_TURNS}) GROUP BY 1) b ON b.doc_id = l.doc_id""")
def zipped(spark, d):
    lines = line_rows(spark, d).withColumnRenamed("line_no", "seg_no")
    return A.zipped(lines, turn_rows(spark, d).withColumnRenamed("text", "said"), "doc_id").select("doc_id", "seg_no", "line", "said", "uneven")


_SEGS = f"SELECT user_id AS doc_id, seg_no FROM ({_SEG})"
_SIZES = f"SELECT a.doc_id, a.n AS n_text, b.n AS n_seg FROM (SELECT doc_id, count(*) AS n FROM ({_SENTENCES}) GROUP BY 1) a JOIN (SELECT doc_id, count(*) AS n FROM ({_SEGS}) GROUP BY 1) b USING (doc_id)"


@R.add("J06_merge", f"""SELECT s.doc_id, s.seg_no::INT AS seg_no, s.text FROM ({_SENTENCES}) s JOIN ({_SEGS}) g USING (doc_id, seg_no) JOIN ({_SIZES}) z ON z.doc_id = s.doc_id WHERE n_text <= n_seg
    UNION ALL {_spread(f'SELECT doc_id, {_WORDS} AS w, n_seg FROM documents JOIN ({_SIZES}) USING (doc_id) WHERE n_text > n_seg', 'doc_id', 'n_seg')}""")
def merged(spark, d):
    segs = segment_rows(spark, d).select(F.col("user_id").alias("doc_id"), "seg_no")
    return A.merged(sentence_rows(spark, d), segs, documents(spark, d).select("doc_id", "text"), "doc_id")


_SEVEN = _spread(f"SELECT doc_id, {_WORDS} AS w FROM documents", "doc_id", "(1 + doc_id % 7)::INT")


def _groups(spark, d):
    return documents(spark, d).select("doc_id", F.col("text").alias("whole"), (1 + F.col("doc_id") % 7).cast("int").alias("n"))


@R.add("J07_redistribute", _SEVEN)
def redistributed(spark, d):
    return A.replace_text(_groups(spark, d), "whole", "n").select("doc_id", "seg_no", "text")


_GATED = f"SELECT doc_id, CASE WHEN {_RATIO} < 0.02 THEN 'trusted' ELSE 'kept' END AS took FROM documents"


@R.add("J08_gate", _GATED)
def gated(spark, d):
    docs = documents(spark, d).select("doc_id", "text", F.lit("trusted").alias("trusted"))
    chosen = A.gated(docs, "text", "trusted")
    return docs.select("doc_id", F.when(chosen == F.col("trusted"), "trusted").otherwise("kept").alias("took"))


@R.add("J09_modes", f"SELECT 'replace' AS mode, * FROM ({_SEVEN}) UNION ALL SELECT 'fallback' AS mode, doc_id, 0 AS seg_no, CASE WHEN took = 'trusted' THEN 'trusted' ELSE {_NORM} END AS text FROM documents JOIN ({_GATED}) USING (doc_id)")
def modes(spark, d):
    """The same groups under an unknown mode (which means replace) and under fallback."""

    def run(name):
        if A.mode_of(name) == "replace":
            return A.replace_text(_groups(spark, d), "whole", "n").select("doc_id", "seg_no", "text")
        docs = documents(spark, d).select("doc_id", text.normalise(F.col("text")).alias("plain"), "text", F.lit("trusted").alias("trusted"))
        low = text.punctuation_ratio(F.col("text")) < 0.02
        return docs.select("doc_id", F.lit(0).alias("seg_no"), F.when(low, F.col("trusted")).otherwise(F.col("plain")).alias("text"))

    return run("unknown").withColumn("mode", F.lit("replace")).unionByName(run("fallback").withColumn("mode", F.lit("fallback")))


_LINED = f"SELECT doc_id, string_agg(line, ' ' ORDER BY line_no) AS text, count(*)::INT AS n FROM ({_LINES}) GROUP BY doc_id"
_LOW = f"SELECT doc_id, n FROM ({_LINED}) WHERE {_RATIO} < 0.02"
_OVER_LINES = _spread(f"SELECT doc_id, {_WORDS} AS w, n FROM documents JOIN (SELECT doc_id, n FROM ({_LINED})) USING (doc_id)", "doc_id", "n")
_FALLBACK = f"""SELECT doc_id, line_no::INT AS seg_no, line AS text FROM ({_LINES}) WHERE doc_id NOT IN (SELECT doc_id FROM ({_LOW}))
    UNION ALL SELECT * FROM ({_OVER_LINES}) WHERE doc_id IN (SELECT doc_id FROM ({_LOW}))"""
_LINE_MERGE = f"""SELECT s.doc_id, s.seg_no::INT AS seg_no, s.text FROM ({_SENTENCES}) s JOIN ({_LINES}) g ON g.doc_id = s.doc_id AND g.line_no = s.seg_no
    JOIN (SELECT doc_id, count(*) AS k FROM ({_SENTENCES}) GROUP BY 1) c ON c.doc_id = s.doc_id JOIN ({_LINED}) l ON l.doc_id = s.doc_id WHERE k <= n
    UNION ALL SELECT * FROM ({_OVER_LINES}) WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, count(*) AS k FROM ({_SENTENCES}) GROUP BY 1) JOIN ({_LINED}) USING (doc_id) WHERE k > n)"""


def _lines(spark, d):
    return line_rows(spark, d).select("doc_id", F.col("line_no").alias("seg_no"), F.col("line").alias("text"))


@R.add("J08_grouped", _FALLBACK)
def gated_lines(spark, d):
    """Documents' lines, with the whole text's words over them where they have too little punctuation."""
    return A.gated_segments(_lines(spark, d), documents(spark, d).select("doc_id", "text"), "doc_id")


@R.add("J09_dispatch", f"SELECT 'merge' AS mode, * FROM ({_LINE_MERGE}) UNION ALL SELECT 'fallback', * FROM ({_FALLBACK}) UNION ALL SELECT 'no such mode', * FROM ({_OVER_LINES})")
def dispatched(spark, d):
    """The same lines under each mode; one without a meaning replaces."""
    docs, out = documents(spark, d).select("doc_id", "text"), None
    for name in ("merge", "fallback", "no such mode"):
        rows = A.dispatched(name, sentence_rows(spark, d), _lines(spark, d), docs, "doc_id").select(F.lit(name).alias("mode"), "doc_id", "seg_no", "text")
        out = rows if out is None else out.unionByName(rows)
    return out


@R.add("J12_compare", f"""SELECT doc_id, seg_no, coalesce(a.text, 'none') AS was, coalesce(b.text, 'none') AS now FROM (SELECT doc_id, line_no AS seg_no, line AS text FROM ({_LINES})) a
    FULL JOIN ({_TURNS}) b USING (doc_id, seg_no)""")
def compared(spark, d):
    before = line_rows(spark, d).select("doc_id", F.col("line_no").alias("seg_no"), F.col("line").alias("text"))
    return A.compared(before, turn_rows(spark, d), "doc_id")
