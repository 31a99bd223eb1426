"""Operators between a trusted text and timed segments: zips, redistribution, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators.order import unrolled


def zipped(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Rows paired by (group, seg_no); the shorter side wins. `uneven` says that the numbers differ."""
    n = lambda df, name: df.groupBy(group).agg(F.count("*").alias(name))
    sizes = n(left, "n_left").join(n(right, "n_right"), group).select(group, (F.col("n_left") != F.col("n_right")).alias("uneven"))
    return left.join(right, [group, "seg_no"]).join(sizes, group)


def redistributed(words: Column, n: Column) -> Column:
    """Words over n segments: word w goes to segment min(w / per, n - 1), per = max(1, words / n).

    Array of (seg_no, text); segments without words are left out.
    """
    per = F.greatest(F.lit(1), F.floor(F.size(words) / n).cast("int"))
    used = F.least(n, F.ceil(F.size(words) / per).cast("int"))
    size = lambda k: F.when(k == n - 1, F.size(words) - k * per).otherwise(per).cast("int")
    some = F.transform(F.sequence(F.lit(0), used - 1), lambda k: F.struct(k.alias("seg_no"), F.array_join(F.slice(words, (k * per + 1).cast("int"), F.greatest(size(k), F.lit(0))), " ").alias("text")))
    return F.when((n > 0) & (F.size(words) > 0), some).otherwise(F.array().cast("array<struct<seg_no:int,text:string>>"))


def words_of(c: Column) -> Column:
    return F.filter(F.split(text.normalise(c), " "), lambda w: F.length(w) > 0)


def _once(value: Column, use) -> Column:
    """use(value), with value evaluated once a row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replace_text(groups: DataFrame, trusted: str, n: str) -> DataFrame:
    """(.., seg_no, text): the trusted text's words over each group's n segments."""
    return unrolled(groups, ["*"], _once(words_of(F.col(trusted)), lambda w: redistributed(w, F.col(n))), "at_", "r").select(*groups.columns, "r.seg_no", "r.text")


def merged(sentences: DataFrame, segments: DataFrame, trusted: DataFrame, group: str) -> DataFrame:
    """Sentences (group, seg_no, text) onto segments (group, seg_no) one by one where there are not more
    sentences than segments; otherwise the words of trusted (a row a group: group, text) over the segments."""
    said = sentences.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col("seg_no").cast("long").alias("seg_no"), "text"))).alias("said"))
    places = segments.groupBy(group).agg(F.collect_set(F.col("seg_no").cast("long")).alias("places"), F.count("*").cast("int").alias("n_seg"))
    both = said.join(places, group).join(trusted.select(group, F.col("text").alias("whole")), group, "left")
    n = F.size("places")
    dense = (F.array_min("places") == 0) & (F.array_max("places") == n - 1)  # from 0 without a gap: nothing to look up
    fit = F.when(dense, F.filter("said", lambda x: x["seg_no"].between(0, n - 1))).otherwise(F.filter("said", lambda x: F.array_contains("places", x["seg_no"])))
    one = F.transform(fit, lambda x: F.struct(x["seg_no"].cast("int").alias("seg_no"), x["text"].alias("text")))
    spread = _once(words_of(F.col("whole")), lambda w: redistributed(w, F.col("n_seg")))
    return unrolled(both, [group], F.when(F.size("said") <= F.col("n_seg"), one).otherwise(spread), "at_", "r").select(group, "r.seg_no", "r.text")


def gated(groups: DataFrame, original: str, trusted: str, least: float = 0.02) -> Column:
    """The trusted text where the original has too little punctuation, else the original."""
    return F.when(text.punctuation_ratio(F.col(original)) < least, F.col(trusted)).otherwise(F.col(original))


def gated_segments(segments: DataFrame, trusted: DataFrame, group: str, least: float = 0.02) -> DataFrame:
    """Segments (group, seg_no, text): where a group's joined text has too little punctuation, the words of
    trusted (a row a group: group, text) over its segments, else as they are. Groups without trusted text stay."""
    said = segments.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col("seg_no").cast("int").alias("seg_no"), "text"))).alias("said"))
    both = said.join(trusted.select(group, F.col("text").alias("whole")), group, "left")
    low = (text.punctuation_ratio(F.array_join(F.col("said.text"), " ")) < least) & F.col("whole").isNotNull()
    spread = _once(words_of(F.col("whole")), lambda w: redistributed(w, F.size("said")))
    return unrolled(both, [group], F.when(low, spread).otherwise(F.col("said")), "at_", "r").select(group, "r.seg_no", "r.text")


def dispatched(mode: str, sentences: DataFrame, segments: DataFrame, trusted: DataFrame, group: str) -> DataFrame:
    """Texts of segments (group, seg_no, text) under a mode: replaced, merged with sentences, or replaced
    only where the gate finds too little punctuation."""
    name = mode_of(mode)
    if name == "merge":
        return merged(sentences, segments, trusted, group)
    if name == "fallback":
        return gated_segments(segments, trusted, group)
    sized = segments.groupBy(group).agg(F.count("*").cast("int").alias("n"))
    return replace_text(trusted.select(group, F.col("text").alias("whole")).join(sized, group), "whole", "n").select(group, "seg_no", "text")


MODES = {"replace": "replace", "merge": "merge", "fallback": "fallback"}


def mode_of(name: str) -> str:
    """The correction's mode; what is unknown means replace."""
    return MODES.get(name, "replace")


def compared(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """Texts before and after, side by side by (group, seg_no); 'none' where one side has no row."""
    b, a = before.select(group, "seg_no", F.col("text").alias("was")), after.select(group, "seg_no", F.col("text").alias("now"))
    none = lambda c: F.coalesce(F.col(c), F.lit("none")).alias(c)
    return b.join(a, [group, "seg_no"], "full").select(group, "seg_no", none("was"), none("now"))
