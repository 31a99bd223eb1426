"""Operators over timed segments: (group, seg_no, s, e), times in integer microseconds.

Order is always (group, seg_no). Every step reads original values only, so each is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators.order import unrolled


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds seg_no from 0 and is_last."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("seg_no", (F.row_number().over(w) - 1).cast("long")).withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())


def repair(df: DataFrame, group: str, gap_us: int = 1000, order: tuple[str, ...] = ("seg_no",)) -> DataFrame:
    """Overlapping neighbours meet half way; after a gap of more than gap_us a segment starts at the end before it."""
    w = Window.partitionBy(group).orderBy(*order)
    before, after = F.lag("e").over(w), F.lead("s").over(w)
    half = lambda a, b: F.floor((a + b) / 2).cast("long")
    s = F.when(before > F.col("s"), half(before, F.col("s"))).when(F.col("s") - before > gap_us, before).otherwise(F.col("s"))
    e = F.when(after < F.col("e"), half(F.col("e"), after)).otherwise(F.col("e"))
    return df.withColumns({"s2": s, "e2": e}).withColumns({"s": F.col("s2"), "e": F.col("e2")}).drop("s2", "e2").withColumn("d", F.col("e") - F.col("s"))


def allocate(sentences: DataFrame, group: str, padding_us: int = 100_000) -> DataFrame:
    """Times for the sentences (seg_no, text) of a segment from 0 to `whole` microseconds.

    What is left after padding and extra time, seven tenths at least, is shared by characters and
    stretched by 1.15; natural breaks get 0.15 s more. Starts are prefix sums of whole microseconds.
    """
    t, every = F.col("text"), Window.partitionBy(group)
    rows = sentences.withColumn("extra", text.extra_time_us(t, padding_us=padding_us))
    rows = rows.withColumns({"n": F.count("*").over(every), "extras": F.sum("extra").over(every), "chars": F.sum(F.length(t)).over(every)})
    free = F.greatest(F.col("whole") - (padding_us * F.col("n") + F.col("extras")), F.expr("(7 * whole) div 10"))
    rows = rows.withColumn("free", free)
    own = F.expr("(free * length(text) * 115) div (chars * 100)") + F.col("extra") + F.when(text.natural_break(t), 150_000).otherwise(0)
    rows = rows.withColumn("own", F.when(F.col("n") == 1, F.col("whole")).otherwise(own))
    w = Window.partitionBy(group).orderBy("seg_no")
    s = F.coalesce(F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("seg_no") * (padding_us // 2)
    last = F.col("seg_no") == F.col("n") - 1
    rows = rows.withColumn("s", s.cast("long")).withColumn("e", F.when(last, F.col("whole")).otherwise(F.col("s") + F.col("own")).cast("long"))
    return rows.select(group, "seg_no", "text", "s", "e", (F.col("e") < F.col("s")).alias("negative"))


def even_parts(s: Column, e: Column, words_of: Column, longest_us: int = 30_000_000) -> Column:
    """Array of (part, s, e, text): a text from s to e in equal parts if that is longer than longest_us, else as
    it is; words by half-even shares, parts without any left out."""
    d = e - s
    k = F.greatest(F.lit(2), F.ceil(d / (0.8 * longest_us))).cast("int")
    words = F.filter(F.split(words_of, " "), lambda w: F.length(w) > 0)

    def parted(x: Column) -> Column:
        share = lambda i: F.bround(F.size(x["words"]) * i / x["k"], 0).cast("int")
        cut = lambda i: s + F.call_function("div", d * i, x["k"])
        held = F.filter(F.sequence(F.lit(0), x["k"] - 1), lambda i: share(i + 1) > share(i))
        said = lambda i: F.array_join(F.slice(x["words"], share(i) + 1, share(i + 1) - share(i)), " ")
        return F.transform(held, lambda i: _part(i, cut(i), cut(i + 1), said(i)))

    known = lambda c: F.when(d.isNotNull(), c)
    return F.when(d > longest_us, text.once(F.struct(words.alias("words"), k.alias("k")), parted)).otherwise(F.array(_part(F.lit(0), known(s), known(e), words_of)))


def _part(part: Column, s: Column, e: Column, said: Column) -> Column:
    return F.struct(part.alias("part"), s.alias("s"), e.alias("e"), said.alias("text"))


def fixed_split(df: DataFrame, longest_us: int = 30_000_000) -> DataFrame:
    """Rows (s, e, text) longer than longest_us in equal parts; words by half-even shares."""
    kept = [c for c in df.columns if c not in ("s", "e", "text")]
    rows = unrolled(df, kept, even_parts(F.col("s"), F.col("e"), F.col("text"), longest_us), "at_", "p")
    return rows.select(*kept, "p.part", "p.s", "p.e", "p.text")


def parts_at_cuts(s: Column, e: Column, said: Column, cuts: Column, least_us: int = 1_000_000) -> Column:
    """Array of (s, e, text): a text from s to e, parted at its cut points (ascending array of microseconds).

    A cut counts only least_us after the current start. A part takes a half-even share of the words,
    one at least; the last takes the rest. One part or none keeps the text whole.
    """
    kind = "array<struct<s:bigint,e:bigint,text:string>>"
    start = F.struct(F.array().cast(kind).alias("out"), s.alias("at"), F.lit(0).alias("used"))

    def add(words: Column, state: Column, cut: Column) -> Column:
        n = F.size(words)
        ok = (cut - state["at"] >= least_us) & (cut < e) & (state["used"] < n)
        share = F.least(n - state["used"], F.greatest(F.lit(1), F.bround(n * (cut - state["at"]) / (e - s), 0).cast("int")))
        one = F.struct(state["at"].alias("s"), cut.alias("e"), F.array_join(F.slice(words, state["used"] + 1, share), " ").alias("text"))
        return F.struct(F.when(ok, F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"), F.when(ok, cut).otherwise(state["at"]).alias("at"), F.when(ok, state["used"] + share).otherwise(state["used"]).cast("int").alias("used"))

    whole = F.array(F.struct(s.alias("s"), e.alias("e"), said.alias("text"))).cast(kind)

    def finish(words: Column, state: Column) -> Column:
        n = F.size(words)
        last = F.struct(state["at"].alias("s"), e.alias("e"), F.array_join(F.slice(words, state["used"] + 1, F.greatest(n - state["used"], F.lit(1))), " ").alias("text"))
        every = F.when(n > state["used"], F.concat(state["out"], F.array(last))).otherwise(state["out"])
        return F.when(F.size(every) > 1, every).otherwise(whole)

    split = F.filter(F.split(said, " "), lambda w: F.length(w) > 0)  # once a text, not once a cut
    parted = text.once(split, lambda w: F.aggregate(cuts, start, lambda x, c: add(w, x, c), lambda x: finish(w, x)))
    return F.when(F.size(cuts) == 0, whole).otherwise(parted)


def split_at_cuts(df: DataFrame, least_us: int = 1_000_000) -> DataFrame:
    """Rows (s, e, text, cuts) parted at their cut points: parts_at_cuts()."""
    kept = [c for c in df.columns if c not in ("s", "e", "text", "cuts")]
    parts = parts_at_cuts(*[F.col(c) for c in ("s", "e", "text", "cuts")], least_us)
    return unrolled(df, kept, parts, "part", "p").select(*kept, "part", "p.s", "p.e", "p.text")


def corrected(df: DataFrame, group: str, actual: str, least_us: int = 100_000, most_us: int = 500_000) -> DataFrame:
    """Ends fitted to an actual length: the last grows by most_us at most, else all are scaled (but for a group that ends at 0)."""
    every = Window.partitionBy(group)
    rows = df.withColumns({"end_": F.max("e").over(every), "last_": F.max("seg_no").over(every)}).withColumn("diff_", F.col(actual) - F.col("end_"))
    grown = (F.col("diff_") > least_us) & (F.col("diff_") - most_us <= least_us)
    scaled = (F.abs("diff_") > least_us) & ~grown & (F.col("end_") != 0)
    ratio = F.col(actual) / F.col("end_")
    fit = lambda c: F.when(scaled, F.round(F.col(c) * ratio).cast("long")).otherwise(F.col(c))
    e = F.when(grown & (F.col("seg_no") == F.col("last_")), F.col("e") + F.least(F.col("diff_"), F.lit(most_us))).otherwise(fit("e"))
    return rows.withColumns({"s": fit("s"), "e": e}).drop("end_", "last_", "diff_")


def preview(df: DataFrame, group: str, most: int = 8, ends: int = 3) -> DataFrame:
    """All rows of groups of at most `most`, else the first and last `ends`."""
    n = F.count("*").over(Window.partitionBy(group))
    return df.withColumn("n", n).filter((F.col("n") <= most) | (F.col("seg_no") < ends) | (F.col("seg_no") >= F.col("n") - ends))


def listed(df: DataFrame, group: str, name: str, most: int = 5, first: int = 3) -> DataFrame:
    """Names in order of seg_no: all of groups of at most `most`, else the first ones and a line "n more"."""
    n = F.count("*").over(Window.partitionBy(group))
    rows = df.select(group, "seg_no", F.col(name).cast("string").alias("line"), n.alias("n")).filter((F.col("n") <= most) | (F.col("seg_no") <= first))
    line = F.when((F.col("n") > most) & (F.col("seg_no") == first), F.concat((F.col("n") - first).cast("string"), F.lit(" more"))).otherwise(F.col("line"))
    return rows.select(group, "seg_no", line.alias("line"))


def summary(df: DataFrame, group: str) -> DataFrame:
    """Number, last end and durations of each group, and whether it needs more splitting."""
    d = F.col("e") - F.col("s")
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.max("e").alias("end_us"), F.avg(d).alias("mean_us"), F.min(d).alias("least_us"), F.max(d).alias("most_us"))
    return out.withColumn("split_more", split_more(*[F.col(c) for c in ("n", "mean_us", "least_us", "most_us")]))


def split_more(n: Column, mean_us: Column, least_us: Column, most_us: Column) -> Column:
    """Whether a group of n segments needs more splitting."""
    return ((n == 1) & (most_us > 3_000_000)) | ((n < 3) & (mean_us > 30_000_000)) | (least_us > 30_000_000)


def best_variant(variants: DataFrame, group: str) -> DataFrame:
    """Of each group's variants (variant: int), the rows of the one with most rows; the first on a tie."""
    n = variants.groupBy(group, "variant").agg(F.count("*").alias("n"))
    best = n.groupBy(group).agg(F.max(F.struct(F.col("n"), -F.col("variant"))).alias("b")).select(group, (-F.col("b.col2")).alias("variant"))
    return variants.join(best, [group, "variant"])


def longer_split(first: Column, second: Column) -> Column:
    """struct(variant, parts): of two arrays of texts the one with more; the first on a tie. No rows are moved."""
    pick = lambda x: F.when(F.size(x["b"]) > F.size(x["a"]), F.struct(F.lit(2).alias("variant"), x["b"].alias("parts"))).otherwise(F.struct(F.lit(1).alias("variant"), x["a"].alias("parts")))
    return F.get(F.transform(F.array(F.struct(first.alias("a"), second.alias("b"))), pick), F.lit(0))


def by_characters(parts: Column, s: Column, e: Column) -> Column:
    """Array of (part, s, e, text): texts one after another from s to e, each as long as its share of all characters."""

    def placed(p: Column, ends: Column) -> Column:
        total, known = F.element_at(ends, -1), lambda c: F.when((e - s).isNotNull(), c)
        times = F.transform(F.concat(F.array(F.lit(0)), ends), lambda n: s + F.call_function("div", (e - s) * n, total))
        shared = text.once(times, lambda at: F.transform(p, lambda x, i: _part(F.lit(0), F.get(at, i), F.get(at, i + 1), x)))
        return F.when(total > 0, shared).otherwise(F.transform(p, lambda x: _part(F.lit(0), known(s), known(e), x)))

    return text.once(parts, lambda p: text.once(text.running(F.transform(p, lambda x: F.length(x))), lambda ends: placed(p, ends)))


def cascade(df: DataFrame, group: str, longest_us: int = 30_000_000) -> DataFrame:
    """Groups of segments (group, seg_no, s, e, text, cuts, actual) refined as far as they need it: group,
    seg_no, s, e, d, text.

    A group that needs more splitting (split_more()) has each text parted at sentences or clauses, whichever
    are more, timed by characters; what is longer than longest_us is parted at its cuts (silences,
    ascending; null: none) where they give more than one part, and evenly if still too long. Other groups
    keep their rows. Then all are fitted to the group's actual end (null: as they are), and neighbours meet.

    A text's pieces are made within its row, and the groups' steps are windows in one order, so that rows
    dealt by group are not moved again.
    """
    s, e, said, every = F.col("s"), F.col("e"), F.col("text"), Window.partitionBy(group)
    more = split_more(*[f.over(every) for f in (F.count("*"), F.avg(e - s), F.min(e - s), F.max(e - s))])
    rows = df.select(group, F.col("seg_no").alias("at_"), "s", "e", "text", F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts"), "actual", F.coalesce(more, F.lit(False)).alias("more_"))
    parts = text.once(longer_split(text.sentences(said), text.clauses(said))["parts"], lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.coalesce(said, F.lit("")))))

    def finer(x: Column) -> Column:
        inside = F.filter("cuts", lambda c: (c > x["s"]) & (c < x["e"]))
        return F.flatten(F.transform(parts_at_cuts(x["s"], x["e"], x["text"], inside), lambda q: even_parts(q["s"], q["e"], q["text"], longest_us)))

    split = F.flatten(F.transform(by_characters(parts, s, e), lambda x: F.when(x["e"] - x["s"] > longest_us, finer(x)).otherwise(F.array(x))))
    pieces = F.when(F.col("more_"), split).otherwise(F.array(_part(F.lit(0), s, e, said)))
    rows = unrolled(rows, [group, "actual", "at_"], pieces, "k_", "p").select(group, "actual", "at_", "k_", "p.s", "p.e", "p.text")
    rows = numbered(rows, group, "at_", "k_").drop("is_last")
    fitted = corrected(rows.withColumn("actual", F.coalesce("actual", F.max("e").over(every))), group, "actual")
    return repair(fitted, group, order=("at_", "k_")).select(group, "seg_no", "s", "e", "d", "text")
