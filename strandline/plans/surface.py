"""Queries of the user-defined surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import strategies as G
from strandline.plans.base import Registry, table
from strandline.plans.scalars import _SENT, _SENTENCES, _STRIP
from strandline.plans.segments import _SPLITTABLE

R = Registry()


@R.add("F01_strategies", f"SELECT doc_id, unnest(range(len(l)))::INT AS seg_no, unnest(l) AS piece FROM (SELECT doc_id, CASE WHEN {_SPLITTABLE} THEN {_SENT} ELSE [text] END AS l FROM documents)")
def strategies(spark, d):
    return G.split(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "seg_no", "piece")


_CUT = f"list_filter(list_transform(regexp_extract_all(text, '(?s)[^,.!?;。！？；]*[,.!?;。！？；]|[^,.!?;。！？；]+$'), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 0)"


@R.add("F01_auto", f"SELECT doc_id, unnest(range(len(l)))::INT AS seg_no, unnest(l) AS piece FROM (SELECT doc_id, CASE WHEN {_SPLITTABLE} THEN {_SENT} WHEN regexp_matches(text, '[,.!?;。！？；]') THEN {_CUT} ELSE [text] END AS l FROM documents)")
def automatic(spark, d):
    """Row by row the first strategy that would split: sentences, else clauses, else the whole text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return G.split(docs, "text", G.preset("default").with_changes(strategy="auto")).select("doc_id", "seg_no", "piece")


@R.add("F02_presets", f"SELECT count(*) FILTER ({_SPLITTABLE}) AS by_default, count(*) FILTER ({_SPLITTABLE.replace('>= 16', '>= 32')}) AS strict FROM documents")
def presets(spark, d):
    c, s = F.col("text"), G.chosen("sentence")
    return table(spark, d, "documents").agg(F.count_if(s.should_split(c, G.preset("unknown"))).alias("by_default"), F.count_if(s.should_split(c, G.preset("default").with_changes(least_chars=16))).alias("strict"))


_BY_PRESET = f"CASE doc_id % 4 WHEN 0 THEN {_SPLITTABLE.replace('>= 16', '>= 32')} WHEN 1 THEN {_SPLITTABLE.replace('>= 16', '>= 8')} ELSE {_SPLITTABLE} END"


@R.add("F03_presets", f"SELECT doc_id, parted, unnest(range(len(l)))::INT AS seg_no, unnest(l) AS piece FROM (SELECT doc_id, coalesce({_BY_PRESET}, false) AS parted, CASE WHEN {_BY_PRESET} THEN {_SENT} ELSE [text] END AS l FROM documents)")
def batch_of_presets(spark, d):
    k = F.col("doc_id") % 4
    named = F.when(k == 0, "Strict").when(k == 1, "loose").when(k == 2, "no such preset")
    return G.split_batch(table(spark, d, "documents").select("doc_id", "text", named.alias("named")), "text", "named").select("doc_id", "parted", "seg_no", "piece")


@R.add("F04_table_function", f"SELECT doc_id, seg_no::INT AS seg_no, text AS piece FROM ({_SENTENCES})")
def table_function(spark, d):
    G.register_table_function(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, s.seg_no, s.piece FROM {docs}, LATERAL split_sentences(text) s", docs=docs)
