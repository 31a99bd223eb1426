"""Operators over words: dictionary checks, suggestions, affixes, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators.order import scanned, unrolled


def tokens(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, word, start_pos, end_pos) of every word, positions from 0, end exclusive.

    Positions are sums over the words before and their gaps, made within the text's row: no row is moved.
    """
    led = lambda p: F.arrays_zip(p.alias("led"), text.running(F.transform(p, lambda x: F.length(x))).alias("end_pos"))
    rows = unrolled(df, [key], text.once(text.led_words(F.col(column)), led), "n", "w")
    rows = rows.select(key, text.without_gap(F.col("w.led")).alias("word"), F.col("w.end_pos").alias("end_pos"))
    return rows.select(key, "word", (F.col("end_pos") - F.length("word")).alias("start_pos"), "end_pos")


def word_forms(df: DataFrame, column: str = "text") -> DataFrame:
    """(form): the distinct lower-case words of all texts, without places."""
    rows = unrolled(df, [], text.led_words(F.col(column)), "n", "led")
    return rows.select(F.lower(text.without_gap(F.col("led"))).alias("form")).distinct()


def unknown(tokens: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Tokens whose lower-case form (added) is not in dictionary (form)."""
    return tokens.withColumn("form", F.lower(word)).join(dictionary.select("form").distinct(), "form", "left_anti")


def _segment(c: str, length: str, number: str, at: str, n: int) -> str:
    """What stands in c at `at` (from 0), as long as segment `number` of a form of that length."""
    size = f"(({number} + 1) * {length} div {n} - {number} * {length} div {n})"
    return f"named_struct('length', {length}, 'number', {number}, 'piece', substring({c}, cast({at} as int) + 1, cast({size} as int)))"


def _own_segments(c: str, reach: int) -> Column:
    """A form in reach + 1 segments: edits leave one of them whole."""
    n = reach + 1
    return F.expr(f"transform(sequence(0, {reach}), k -> {_segment(c, f'length({c})', 'k', f'k * length({c}) div {n}', n)})")


def _met_segments(c: str, reach: int) -> Column:
    """The segments that forms within `reach` edits of c can have whole in it: those of lengths that near,
    each at places that near. As many as reach alone says, each no longer than c."""
    n, far = reach + 1, f"{reach}"
    start = f"k * l div {n}"
    size = f"((k + 1) * l div {n} - {start})"
    at = f"filter(sequence(greatest(0, {start} - {far}), greatest(0, {start} + {far})), p -> p + {size} <= length({c}))"
    return F.expr(f"array_distinct(flatten(flatten(transform(sequence(greatest(1, length({c}) - {far}), length({c}) + {far}), l -> transform(sequence(0, {reach}), k -> transform({at}, p -> {_segment(c, 'l', 'k', 'p', n)}))))))")


def near_forms(forms: DataFrame, dictionary: DataFrame, reach: int) -> DataFrame:
    """(bad, form, class): forms (bad) and dictionary forms (form) whose edit distance, the class, is 1 to reach.

    Words meet by a segment that the edits leave whole, so no pair is tried without a key, and keys grow
    with a word's length and no faster.
    """
    left = unrolled(forms, ["bad"], _met_segments("bad", reach), "n", "key").drop("n")
    right = unrolled(dictionary, ["form"], _own_segments("form", reach), "n", "key").drop("n")
    met = left.join(right, "key").select("bad", "form", F.levenshtein("bad", "form", reach).alias("class"))
    return met.filter(F.col("class").between(1, reach)).distinct()


def swapped_forms(forms: DataFrame, swaps: DataFrame) -> DataFrame:
    """(bad, form): each form with one occurrence of a rule's src as its dst. Rules are joined by what stands at each place."""
    sizes = [r["n"] for r in swaps.select(F.length("src").alias("n")).filter("n > 0").distinct().collect()]  # a few lengths
    at = forms.filter(F.length("bad") > 0).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("bad"))))
    at = at.withColumn("n", F.explode(F.lit(sizes) if sizes else F.array().cast("array<int>"))).withColumn("src", F.substring("bad", F.col("at"), F.col("n"))).filter("length(src) = n")
    made = at.join(swaps.select("src", "dst").distinct(), "src")
    return made.select("bad", F.concat(F.expr("substring(bad, 1, at - 1)"), "dst", F.expr("substring(bad, at + n, length(bad))")).alias("form")).distinct()


def suggestions(forms: DataFrame, dictionary: DataFrame, swaps: DataFrame, most: int = 5, reach: int = 1) -> DataFrame:
    """For each form, up to `most` dictionary forms: those that a swap (src, dst) gives first (class 0), then
    those at edit distances up to `reach`, nearer first, then by form.

    Forms too long to come near the longest dictionary form take no part, since nothing can be suggested.
    """
    known = dictionary.select("form").filter("form is not null").distinct()
    bad = forms.select(F.col("form").alias("bad")).filter("bad is not null")
    longest = known.agg(F.max(F.length("form"))).first()[0] or 0
    shrinks = swaps.agg(F.max(F.length("src") - F.length("dst"))).first()[0] or 0
    near = near_forms(bad.filter(F.length("bad") <= longest + reach), known, reach)
    first = swapped_forms(bad.filter(F.length("bad") <= longest + shrinks), swaps).filter("bad <> form")
    first = first.join(known, "form", "left_semi").select("bad", "form", F.lit(0).alias("class"))
    best = first.unionByName(near).groupBy("bad", "form").agg(F.min("class").alias("class"))
    rank = F.row_number().over(Window.partitionBy("bad").orderBy("class", "form"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most)


def affixed(stems: DataFrame, rules: DataFrame) -> DataFrame:
    """(stem, form, made): stems (stem, flags) with the rules (kind, flag, cross, strip, add, cond) of their
    flags whose condition they meet; prefix and suffix together only if both allow it."""
    s = stems.select("stem", F.explode("flags").alias("flag"))
    met = s.join(rules, "flag").filter("stem rlike cond")
    suffix = met.filter("kind = 'SFX'").select("stem", F.expr("concat(substring(stem, 1, length(stem) - length(strip)), add)").alias("form"), "cross")
    prefix = met.filter("kind = 'PFX'").select("stem", F.expr("concat(add, substring(stem, length(strip) + 1))").alias("form"), "cross", "add")
    both = prefix.filter("cross").select("stem", "add").join(suffix.filter("cross").select("stem", "form"), "stem").select("stem", F.concat("add", "form").alias("form"), F.lit("both").alias("made"))
    own = stems.select("stem", F.col("stem").alias("form"), F.lit("stem").alias("made"))
    return own.union(suffix.select("stem", "form", F.lit("suffix"))).union(prefix.select("stem", "form", F.lit("prefix"))).union(both)


def sections(lines: DataFrame, group: str, order: list[str], heading, line: str) -> DataFrame:
    """Lines with the heading before them in their group ('' before the first); heading rows are dropped."""
    rows = lines.withColumn("heading_", heading)
    rows = scanned(rows, [group], order, section=("last", F.when(F.col("heading_"), F.col(line))))
    return rows.withColumn("section", F.coalesce("section", F.lit(""))).filter(~F.col("heading_")).drop("heading_")
