"""Queries over timed segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import segments as S
from strandline.operators.order import unrolled
from strandline.plans.base import Registry, documents, table
from strandline.plans.scalars import _EXTRA, _NORM, _SENTENCES, _STRIP, sentence_rows

R = Registry()
_SEG = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_no, epoch_us(ts) AS s, epoch_us(ts) + round(value * 600000000)::BIGINT AS e FROM events"
_REL = f"SELECT user_id, seg_no, s - min(s) OVER (PARTITION BY user_id) AS s, e - min(s) OVER (PARTITION BY user_id) AS e FROM ({_SEG})"


def segment_rows(spark, d):
    ev = table(spark, d, "events").withColumn("s", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    ev = ev.withColumn("e", F.col("s") + F.round(F.col("value") * 600_000_000).cast("long"))
    return S.numbered(ev, "user_id", "ts", "event_id").select("user_id", "event_id", "seg_no", "is_last", "s", "e")


def relative_rows(spark, d):
    rows, first = segment_rows(spark, d), F.min("s").over(Window.partitionBy("user_id"))
    return rows.withColumn("z", first).select("user_id", "seg_no", (F.col("s") - F.col("z")).alias("s"), (F.col("e") - F.col("z")).alias("e"))


_REPAIR = """SELECT {g}, seg_no, s, e, e - s AS d FROM (SELECT {g}, seg_no,
    CASE WHEN pe > s THEN (pe + s) // 2 WHEN s - pe > 1000 THEN pe ELSE s END AS s, CASE WHEN ns < e THEN (e + ns) // 2 ELSE e END AS e
    FROM (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns FROM ({src}) WINDOW w AS (PARTITION BY {g} ORDER BY seg_no)))"""


@R.add("W01_repair", _REPAIR.format(g="user_id", src=_SEG))
def repair(spark, d):
    return S.repair(segment_rows(spark, d).select("user_id", "seg_no", "s", "e"), "user_id")


_ALLOC = f"""WITH a AS (SELECT d.doc_id, s.seg_no, s.text, round(d.n_chars * 1000000 / 15)::BIGINT AS whole FROM ({_SENTENCES}) s JOIN documents d USING (doc_id)),
    b AS (SELECT *, {_EXTRA} AS extra FROM a),
    c AS (SELECT *, count(*) OVER g AS n, (sum(extra) OVER g)::BIGINT AS extras, (sum(length(text)) OVER g)::BIGINT AS chars FROM b WINDOW g AS (PARTITION BY doc_id)),
    f AS (SELECT *, greatest(whole - (100000 * n + extras), (7 * whole) // 10) AS free FROM c),
    o AS (SELECT *, CASE WHEN n = 1 THEN whole ELSE (free * length(text) * 115) // (chars * 100) + extra + CASE WHEN regexp_matches(text, '[.!?;。！？；]$') THEN 150000 ELSE 0 END END AS own FROM f),
    p AS (SELECT *, (coalesce(sum(own) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + seg_no * 50000)::BIGINT AS s FROM o),
    q AS (SELECT doc_id, seg_no, text, s, (CASE WHEN seg_no = n - 1 THEN whole ELSE s + own END)::BIGINT AS e FROM p)"""


def timed_sentences(spark, d):
    whole = F.round(F.col("n_chars") * 1_000_000 / 15).cast("long").alias("whole")
    rows = unrolled(documents(spark, d), ["doc_id", whole], text.sentences(F.col("text")), "seg_no", "text")
    return S.allocate(rows.withColumn("seg_no", F.col("seg_no").cast("long")), "doc_id")


R.add("W02_allocate", _ALLOC + " SELECT doc_id, seg_no, text, s, e, e < s AS negative FROM q")(timed_sentences)


@R.add("slice_sentences_timed", _ALLOC + " SELECT r.*, q.text FROM (" + _REPAIR.format(g="doc_id", src="SELECT doc_id, seg_no, s, e FROM q") + ") r JOIN q USING (doc_id, seg_no)")
def flagship(spark, d):
    """Sentences with times for every document."""
    return S.repair(timed_sentences(spark, d).select("doc_id", "seg_no", "text", "s", "e"), "doc_id").select("doc_id", "seg_no", "s", "e", "d", "text")


_ONE = f"SELECT doc_id, {_NORM} AS text, 0::BIGINT AS s, round(n_chars * 1000000 / 15)::BIGINT AS e FROM documents"


def _whole(spark, d):
    return documents(spark, d).select("doc_id", text.normalise(F.col("text")).alias("text"), F.lit(0).cast("long").alias("s"), F.round(F.col("n_chars") * 1_000_000 / 15).cast("long").alias("e"))


def _fixed(src, keys):
    return f"""SELECT {keys}, part, s + ((e - s) * part) // k AS s, s + ((e - s) * (part + 1)) // k AS e, CASE WHEN k = 1 THEN text ELSE array_to_string(words[a + 1:b], ' ') END AS text FROM (
    SELECT *, round_even(len(words) * part / k, 0)::INT AS a, round_even(len(words) * (part + 1) / k, 0)::INT AS b FROM (
    SELECT *, unnest(range(k))::INT AS part FROM (SELECT *, CASE WHEN e - s > 30000000 THEN greatest(2, ceil((e - s) / (0.8 * 30000000)))::INT ELSE 1 END AS k,
    list_filter(string_split(text, ' '), lambda x: length(x) > 0) AS words FROM ({src})))) WHERE k = 1 OR b > a"""


@R.add("W03_fixed_split", _fixed(_ONE, "doc_id"))
def fixed(spark, d):
    return S.fixed_split(_whole(spark, d)).select("doc_id", "part", "s", "e", "text")


def _silences(spark, d):
    """Cut points that users' events would give: user_id, cuts."""
    return relative_rows(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_set(F.expr("s div 60"))).alias("cuts"))


@R.add("W07_cut_split")
def cut_split(spark, d):
    """All documents, parted at cut points that their events' silence would give; whole without any."""
    rows = _whole(spark, d).join(_silences(spark, d), F.col("doc_id") == F.col("user_id"), "left").drop("user_id")
    return S.split_at_cuts(rows.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>"))))


_ACTUAL = f"SELECT *, max(e) OVER (PARTITION BY user_id) + (user_id % 5 - 2) * 400000 AS actual FROM ({_REL})"


@R.add("W10_correct", f"""WITH a AS ({_ACTUAL}), b AS (SELECT *, max(e) OVER g AS mx, max(seg_no) OVER g AS last FROM a WINDOW g AS (PARTITION BY user_id)),
    c AS (SELECT *, actual - mx AS diff, actual - mx > 100000 AND actual - mx - 500000 <= 100000 AS grown FROM b)
    SELECT user_id, seg_no, CASE WHEN abs(diff) > 100000 AND NOT grown THEN round(s * (actual / mx))::BIGINT ELSE s END AS s,
    CASE WHEN grown AND seg_no = last THEN e + least(diff, 500000) WHEN abs(diff) > 100000 AND NOT grown THEN round(e * (actual / mx))::BIGINT ELSE e END AS e FROM c""")
def correct(spark, d):
    rows = relative_rows(spark, d).withColumn("actual", F.max("e").over(Window.partitionBy("user_id")) + (F.col("user_id") % 5 - 2) * 400_000)
    return S.corrected(rows, "user_id", "actual").select("user_id", "seg_no", "s", "e")


@R.add("W11_ordinals", f"SELECT user_id, event_id, seg_no, lead(1) OVER (PARTITION BY user_id ORDER BY seg_no) IS NULL AS is_last FROM ({_SEG})")
def ordinals(spark, d):
    return segment_rows(spark, d).select("user_id", "event_id", "seg_no", "is_last")


@R.add("W12_preview", f"SELECT user_id, seg_no, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ({_SEG})) WHERE n <= 8 OR seg_no < 3 OR seg_no >= n - 3")
def preview(spark, d):
    return S.preview(segment_rows(spark, d), "user_id").select("user_id", "seg_no", "n")


@R.add("W12_listed", """SELECT brand, seg_no, CASE WHEN n > 5 AND seg_no = 3 THEN (n - 3) || ' more' ELSE name END AS line FROM (
    SELECT p_brand AS brand, p_name AS name, row_number() OVER w - 1 AS seg_no, count(*) OVER (PARTITION BY p_brand) AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_name, p_partkey)) WHERE n <= 5 OR seg_no <= 3""")
def listed(spark, d):
    """Names of each brand's parts, long lists cut short."""
    place = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")) - 1).cast("long")
    return S.listed(table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_name", place.alias("seg_no")), "brand", "p_name")


_SUM = f"SELECT user_id, count(*) AS n, max(e) AS end_us, avg(e - s) AS mean_us, min(e - s) AS least_us, max(e - s) AS most_us FROM ({_SEG}) GROUP BY user_id"


@R.add("A06_summary", f"SELECT user_id, n, end_us, round(mean_us, 2) AS mean_us, least_us, most_us FROM ({_SUM})")
def summary(spark, d):
    return S.summary(segment_rows(spark, d), "user_id").select("user_id", "n", "end_us", F.round("mean_us", 2).alias("mean_us"), "least_us", "most_us")


@R.add("A07_split_more", f"SELECT user_id, (n = 1 AND most_us > 3000000) OR (n < 3 AND mean_us > 30000000) OR least_us > 30000000 AS split_more FROM ({_SUM})")
def split_more(spark, d):
    return S.summary(segment_rows(spark, d), "user_id").select("user_id", "split_more")


_N_END = "(length(text) - length(translate(text, '.!?;。！？；', '')))"
_STRIPPED = _STRIP.format("text")
_SPLITTABLE = f"({_STRIPPED} <> '' AND length(text) >= 16 AND {_N_END} > 0 AND NOT ({_N_END} = 1 AND regexp_matches({_STRIPPED}, '[.!?;。！？；]$')))"


@R.add("A08_precheck", f"SELECT lang, source, count(*) AS n, CASE WHEN count(*) >= 2 OR bool_or({_SPLITTABLE}) THEN 'split' ELSE 'skipped' END AS status FROM documents GROUP BY lang, source")
def precheck(spark, d):
    any_ = F.bool_or(text.splittable(F.col("text")))
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.when((F.count("*") >= 2) | any_, "split").otherwise("skipped").alias("status"))


@R.add("A09_residual", f"SELECT user_id, abs((user_id % 5 - 2) * 60000) <= 100000 AS fits, max(e) AS end_us FROM ({_REL}) GROUP BY user_id")
def residual(spark, d):
    rows = relative_rows(spark, d).groupBy("user_id").agg(F.max("e").alias("end_us"))
    actual = F.col("end_us") + (F.col("user_id") % 5 - 2) * 60_000
    return rows.select("user_id", (F.abs(actual - F.col("end_us")) <= 100_000).alias("fits"), "end_us")


_CLAUSES = rf"""SELECT doc_id, unnest(range(len(l))) AS seg_no, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(
    regexp_extract_all(text, '(?s)[^,.!?;。！？；]*[,.!?;。！？；]|[^,.!?;。！？；]+$'), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 0) AS l FROM documents)"""
_VARIANTS = f"SELECT doc_id, seg_no, text, 1 AS variant FROM ({_SENTENCES}) UNION ALL SELECT doc_id, seg_no, text, 2 AS variant FROM ({_CLAUSES})"
_BEST = f"SELECT v.* FROM ({_VARIANTS}) v JOIN (SELECT doc_id, variant FROM (SELECT doc_id, variant, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, variant) AS r FROM ({_VARIANTS}) GROUP BY doc_id, variant) WHERE r = 1) b USING (doc_id, variant)"


def _longer(spark, d):
    """Documents' sentences or clauses, whichever are more: doc_id, best (variant, parts)."""
    best = S.longer_split(text.sentences(F.col("text")), text.clauses(F.col("text")))
    return documents(spark, d).select("doc_id", best.alias("best"))


def variants(spark, d):
    rows = unrolled(_longer(spark, d), ["doc_id", F.col("best.variant").alias("variant")], F.col("best.parts"), "seg_no", "text")
    return rows.select("doc_id", F.col("seg_no").cast("long").alias("seg_no"), "text", "variant")


@R.add("A14_best_variant", f"SELECT doc_id, variant, count(*) AS n FROM ({_BEST}) GROUP BY doc_id, variant")
def best(spark, d):
    """Counted where they are made: a document is a row."""
    counted = F.transform(F.array("best"), lambda b: F.struct(b["variant"].alias("variant"), F.size(b["parts"]).cast("long").alias("n")))
    # a filter above would be pushed down and split each text again
    return _longer(spark, d).select("doc_id", F.inline(F.filter(counted, lambda c: c["n"] > 0)))


_CASCADE = f"""SELECT doc_id, seg_no, text, (e * done) // total AS s, (e * (done + length(text))) // total AS e FROM (
    SELECT b.doc_id, b.seg_no, b.text, o.e, (sum(length(b.text)) OVER g)::BIGINT AS total, (sum(length(b.text)) OVER (PARTITION BY b.doc_id ORDER BY b.seg_no ROWS UNBOUNDED PRECEDING))::BIGINT - length(b.text) AS done
    FROM ({_BEST}) b JOIN ({_ONE}) o USING (doc_id) WHERE o.e > 3000000 WINDOW g AS (PARTITION BY b.doc_id))"""


@R.add("W14_cascade", f"""SELECT * FROM ({_fixed(_CASCADE, 'doc_id, seg_no')}) UNION ALL BY NAME SELECT doc_id, 0::BIGINT AS seg_no, 0 AS part, s, e, text FROM ({_ONE}) WHERE e <= 3000000""")
def cascade(spark, d):
    """Documents that need it: their best variant, timed by characters, long rows split evenly."""
    one = _whole(spark, d)
    w = Window.partitionBy("doc_id")
    rows = variants(spark, d).join(one.filter("e > 3000000").select("doc_id", "e"), "doc_id")
    rows = rows.withColumns({"total": F.sum(F.length("text")).over(w), "done": F.sum(F.length("text")).over(w.orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")})
    rows = rows.select("doc_id", "seg_no", "text", F.expr("(e * done) div total").alias("s"), F.expr("(e * (done + length(text))) div total").alias("e"))
    short = one.filter("e <= 3000000").select("doc_id", F.lit(0).cast("long").alias("seg_no"), F.lit(0).alias("part"), "s", "e", "text")
    return S.fixed_split(rows).select("doc_id", "seg_no", "part", "s", "e", "text").unionByName(short)


_FITTED = """SELECT doc_id, seg_no, text, CASE WHEN abs(diff) > 100000 AND NOT grown THEN round(s * (actual / mx))::BIGINT ELSE s END AS s,
    CASE WHEN grown AND seg_no = last THEN e + least(diff, 500000) WHEN abs(diff) > 100000 AND NOT grown THEN round(e * (actual / mx))::BIGINT ELSE e END AS e
    FROM (SELECT *, actual - mx AS diff, actual - mx > 100000 AND actual - mx - 500000 <= 100000 AS grown FROM (
    SELECT *, max(e) OVER g AS mx, max(seg_no) OVER g AS last, max(whole) OVER g + (doc_id % 5 - 2) * 400000 AS actual FROM ({src}) WINDOW g AS (PARTITION BY doc_id)))"""
_REFINED = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no, part) - 1 AS seg_no, s, e, text, whole FROM (
    SELECT f.*, o.e AS whole FROM (SELECT * FROM ({_fixed(_CASCADE, 'doc_id, seg_no')}) UNION ALL BY NAME SELECT doc_id, 0::BIGINT AS seg_no, 0 AS part, s, e, text FROM ({_ONE}) WHERE e <= 3000000) f JOIN ({_ONE}) o USING (doc_id))"""


def _timed(spark, d, cuts=None):
    """Every document as one segment, its cuts, and the end that it is to have."""
    rows = _whole(spark, d).select("doc_id", F.lit(0).cast("long").alias("seg_no"), "s", "e", "text", (F.col("e") + (F.col("doc_id") % 5 - 2) * 400_000).alias("actual"))
    if cuts is None:
        return rows.withColumn("cuts", F.lit(None).cast("array<bigint>"))
    return rows.join(cuts, F.col("doc_id") == F.col("user_id"), "left").drop("user_id")


_NORMAL = f"SELECT doc_id, {_NORM} AS text, n_chars FROM documents"


@R.add("W14_refined", f"WITH nd AS ({_NORMAL}), n AS (SELECT * FROM ({_FITTED.format(src=_REFINED).replace('FROM documents', 'FROM nd')})) SELECT r.*, n.text FROM (" + _REPAIR.format(g="doc_id", src="SELECT doc_id, seg_no, s, e FROM n") + ") r JOIN n USING (doc_id, seg_no)")
def refined(spark, d):
    """The whole cascade over documents without silences: gate, variant, even split, correction, repair."""
    return S.cascade(_timed(spark, d), "doc_id")


@R.add("W14_silence")
def refined_at_silence(spark, d):
    """The whole cascade, long rows parted first at the silences that the documents' events would give."""
    return S.cascade(_timed(spark, d, _silences(spark, d)), "doc_id")
