"""Queries over words and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import lexicon as L
from strandline.plans.base import Registry, documents, table
from strandline.plans.scalars import _TOKENS, token_rows
from strandline.sources import readers
from strandline.sources.folders import scratch

R = Registry()
_BENCH = _TOKENS.replace("SRC", "(SELECT item_id AS doc_id, text FROM benchmark)")
_DICT = f"SELECT DISTINCT lower(word) AS form FROM ({_BENCH})"
_DOC = _TOKENS.replace("SRC", "documents")


def dictionary(spark, d):
    rows = token_rows(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    return rows.select(F.lower("word").alias("form")).distinct()


@R.add("J01_unknown", f"SELECT doc_id, lower(word) AS form, count(*) AS n, min(start_pos) AS first FROM ({_DOC}) WHERE lower(word) NOT IN ({_DICT}) GROUP BY 1, 2")
def unknown(spark, d):
    """Counted within each text first: a form of it is one row before words meet the dictionary."""
    rows = token_rows(documents(spark, d).select("doc_id", "text")).groupBy("doc_id", F.lower("word").alias("form"))
    return L.unknown(rows.agg(F.count("*").alias("n"), F.min("start_pos").alias("first")), dictionary(spark, d), "form").select("doc_id", "form", "n", "first")


# Replacement rules of English spelling, as an affix file has them.
_SWAPS = """REP 90
REP a ei
REP ei a
REP a ey
REP ey a
REP ai ie
REP ie ai
REP alot a_lot
REP are air
REP are ear
REP are eir
REP air are
REP air ere
REP ere air
REP ere ear
REP ere eir
REP ear are
REP ear air
REP ear ere
REP eir are
REP eir ere
REP ch te
REP te ch
REP ch ti
REP ti ch
REP ch tu
REP tu ch
REP ch s
REP s ch
REP ch k
REP k ch
REP f ph
REP ph f
REP gh f
REP f gh
REP i igh
REP igh i
REP i uy
REP uy i
REP i ee
REP ee i
REP j di
REP di j
REP j gg
REP gg j
REP j ge
REP ge j
REP s ti
REP ti s
REP s ci
REP ci s
REP k cc
REP cc k
REP k qu
REP qu k
REP kw qu
REP o eau
REP eau o
REP o ew
REP ew o
REP oo ew
REP ew oo
REP ew ui
REP ui ew
REP oo ui
REP ui oo
REP ew u
REP u ew
REP oo u
REP u oo
REP u oe
REP oe u
REP u ieu
REP ieu u
REP ue ew
REP ew ue
REP uff ough
REP oo ieu
REP ieu oo
REP ier ear
REP ear ier
REP ear air
REP air ear
REP w qu
REP qu w
REP z ss
REP ss z
REP shun tion
REP shun sion
REP shun cion
REP size cise
"""


@R.add("J02_suggest")
def suggest(spark, d):
    """Forms are written before they are looked up, since two steps read them with filters of their own, for which
    Spark would make them from the texts again."""
    known = dictionary(spark, d)
    path, bad = scratch(spark, "rules"), scratch(spark, "forms")
    spark.range(1).select(F.lit(_SWAPS.strip()).alias("value")).write.text(path)
    L.unknown(L.word_forms(documents(spark, d)), known, "form").select("form").write.parquet(bad)
    return L.suggestions(spark.read.schema("form string").parquet(bad), known, readers.replacements(spark, path), reach=2)


_RULES = [
    ("SFX", "A", True, "y", "ies", "[^aeiou]y$"), ("SFX", "A", True, "", "s", "[^sxzhy]$"), ("SFX", "B", True, "e", "ing", "e$"), ("SFX", "B", True, "", "ing", "[^e]$"),
    ("SFX", "C", False, "", "ness", "[^y]$"), ("PFX", "A", True, "", "un", "."), ("PFX", "B", False, "", "re", "."),
]
_RULE_SQL = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{f}' AS flag, {c} AS x, '{s}' AS strip, '{a}' AS addition, '{p}' AS cond" for k, f, c, s, a, p in _RULES)
_STEMS = "SELECT DISTINCT lower(p_name) AS stem, ['A', 'B', 'C'][1 + p_size % 3] AS flag FROM part"
_FORMS = f"""WITH s AS ({_STEMS}), r AS ({_RULE_SQL}), m AS (SELECT s.stem, r.* FROM s JOIN r ON s.flag = r.flag AND regexp_matches(s.stem, r.cond)),
    x AS (SELECT stem, left(stem, length(stem) - length(strip)) || addition AS form, x FROM m WHERE kind = 'SFX'), p AS (SELECT stem, addition || substr(stem, length(strip) + 1) AS form, x, addition FROM m WHERE kind = 'PFX')
    SELECT stem, stem AS form, 'stem' AS made FROM (SELECT DISTINCT stem, flag FROM s) UNION ALL SELECT stem, form, 'suffix' FROM x UNION ALL SELECT stem, form, 'prefix' FROM p
    UNION ALL SELECT p.stem, p.addition || x.form, 'both' FROM p JOIN x ON p.stem = x.stem AND p.x AND x.x"""


def _forms(spark, d):
    flag = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("p_size") % 3 + 1)
    stems = table(spark, d, "part").select(F.lower("p_name").alias("stem"), F.array(flag).alias("flags")).distinct()
    return L.affixed(stems, spark.createDataFrame(_RULES, "kind string, flag string, cross boolean, strip string, add string, cond string"))


R.add("J03_affixes", _FORMS)(_forms)


@R.add("U02_forms", f"SELECT DISTINCT form FROM ({_FORMS})")
def forms(spark, d):
    return _forms(spark, d).select("form").distinct()


@R.add("W04_sections", "SELECT conv_id, turn, text, coalesce(section, '') AS section FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS section FROM conversations) WHERE role <> 'user'")
def sections(spark, d):
    rows = L.sections(table(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], F.col("role") == "user", "text")
    return rows.select("conv_id", "turn", "text", "section")
