"""Column functions over text: splitting, features, names, numbers.

Lengths and positions count code points. White space means ASCII white space unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a sentence, and those that end a clause; kinds of files.
ENDINGS = ".!?;。！？；"
CLAUSES = "," + ENDINGS
INTONED = "!?！？"
SUPPORTED = (".wav", ".mp3", ".m4a", ".wma", ".aac", ".flac", ".ogg", ".mp4")

_SPACES = " \t\r\n\f"
#: One character at least, up to the next run of . ! ? or the end, in one pass over each.
SENTENCE = r"(?s).[^.!?]*(?:[.!?]+|$)"


def normalise(c: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.trim(F.regexp_replace(c, r"[\t\r\n\f][ \t\r\n\f]*| [ \t\r\n\f]+", " "))  # single spaces are no matches


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(_SPACES))


def is_blank(c: Column) -> Column:
    """Null or only white space."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def _kept(pieces: Column, clean) -> Column:
    return F.filter(F.transform(pieces, clean), lambda p: F.length(p) > 0)


def _pieces(c: Column, pattern: str) -> Column:
    return _kept(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), strip)


def _cut_after(c: Column, chars: str) -> Column:
    """Stripped parts that end with one of chars, and the rest. A class with characters beyond Latin-1 is slow to
    match at length, so places are looked for, not what stands between them, and only a text that has such
    characters is held against all of chars."""
    plain = "".join(x for x in chars if x < "\x80")
    wide = reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in chars if x not in plain], F.lit(False))
    cut = lambda ends: F.split(strip(c), f"(?<=[{ends}])[{_SPACES}]*+")
    return F.filter(F.when(wide, cut(chars)).otherwise(cut(plain)), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Pieces of the normalised text, each up to a run of . ! ? or the end."""
    return _kept(F.regexp_extract_all(normalise(c), F.lit(SENTENCE), F.lit(0)), lambda p: F.trim(p))


def clauses(c: Column) -> Column:
    """Pieces up to one of nine characters, which stay; the remainder is kept."""
    return _cut_after(c, CLAUSES)


def secondary(c: Column, longest: int = 80) -> Column:
    """A piece longer than `longest`, cut after runs of , : ; (shorter ones stay whole)."""
    cut = _pieces(c, "(?s)[^,:;]*[,:;]+|[^,:;]+$")
    return F.when(F.length(c) > longest, cut).otherwise(F.array(c))


def packed(c: Column, longest: int = 80) -> Column:
    """Words packed greedily into lines of at most `longest` characters.

    A word's separator is counted before a full line is closed, so a line after the first starts with
    the word's length plus one; a word that is too long stands alone.
    """
    words = F.trim(F.regexp_replace(c, "  +", " "))
    line = lambda start, n: rf"{start}.{{1,{n}}}(?= |\z)|{start}[^ ]+"
    found = F.regexp_extract_all(words, F.lit(f"(?s){line('^', longest)}|{line(' ', longest - 1)}"), F.lit(0))
    return F.transform(found, lambda p: F.trim(p))


def once(value: Column, use) -> Column:
    """use(value), with value evaluated once a row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes: Column) -> Column:
    """Sums of an array of sizes up to each of them, by doubling: each pass adds the value twice as far before."""

    def passes(x: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.log2(F.size(x))) - 1).cast("int")
        reach = F.transform(F.sequence(F.lit(0), last), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(reach, x, lambda y, far: F.transform(y, lambda v, i: v + F.coalesce(F.get(y, i - far), F.lit(0))))

    return once(sizes, passes)


def positioned(c: Column, least: int = 8) -> Column:
    """Sentences with positions: array of (text, start_pos, end_pos, char_len), end inclusive.

    A cut needs `least` trimmed characters gathered; shorter pieces go on. start_pos follows the last
    accepted cut. A tail of `least` or more is a sentence; a shorter one is appended to the last with
    a space (even an empty one); without any sentence it is dropped.
    """
    cut = rf"[{_SPACES}]*+[^{_SPACES}].{{{least - 2},}}?[{ENDINGS}]" if least > 1 else f".*?[{ENDINGS}]"
    found = F.regexp_extract_all(c, F.lit(f"(?s){cut}|.+"), F.lit(0))
    kind = "array<struct<text:string,start_pos:int,end_pos:int,char_len:int>>"

    def placed(p: Column) -> Column:
        one = lambda x: F.struct(x["t"].alias("text"), x["a"].alias("start_pos"), x["b"].alias("end_pos"), F.length(x["t"]).alias("char_len"))
        made = lambda ends: F.transform(p, lambda x, i: once(F.struct(strip(x).alias("t"), (F.get(ends, i) - F.length(x)).alias("a"), (F.get(ends, i) - 1).alias("b")), one))
        return once(running(F.transform(p, lambda x: F.length(x))), made)

    def finish(out: Column) -> Column:
        n, last = F.size(out), F.element_at(out, -1)
        ended = last["text"].rlike(rf"[{ENDINGS}]\z") & (last["char_len"] >= least)  # no tail

        def grown(one: Column, tail: Column, end: Column) -> Column:
            longer = F.concat(one["text"], F.lit(" "), tail)
            return F.array(F.struct(longer.alias("text"), one["start_pos"].alias("start_pos"), end.alias("end_pos"), F.length(longer).alias("char_len")))

        bare = F.concat(F.slice(out, F.lit(1), n - 1), grown(last, F.lit(""), last["end_pos"]))
        short = F.concat(F.slice(out, F.lit(1), n - 2), grown(F.get(out, n - 2), last["text"], last["end_pos"]))
        none = F.array().cast(kind)
        return F.when(n == 0, none).when(ended, bare).when(last["char_len"] >= least, out).when(n > 1, short).otherwise(none)

    return F.when(c.isNotNull(), once(once(found, placed), finish))


def count_of(c: Column, chars: str) -> Column:
    """How many characters of c are among chars."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def splittable(c: Column, least: int = 8) -> Column:
    """Long enough to part, with an ending character that is not just the last one."""
    n = count_of(c, ENDINGS)
    last = strip(c).rlike(f"[{ENDINGS}]$")
    return ~is_blank(c) & (F.length(c) >= 2 * least) & (n > 0) & ~((n == 1) & last)


def natural_break(c: Column) -> Column:
    return c.rlike(rf"[{ENDINGS}][ \t\r\n\f]*$")


def features(c: Column, least: int = 8) -> Column:
    """Names of a sentence's features."""
    intoned, short = c.rlike(f"[{INTONED}]$"), F.length(c) < 2 * least
    found = F.array_compact(F.array(F.when(intoned, "intonation"), F.when(short, "short")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("plain")))


def extra_time_us(c: Column, least: int = 8, padding_us: int = 100_000, extend: bool = True) -> Column:
    """Extra microseconds that a sentence's features ask for."""
    intoned = F.when(c.rlike(f"[{INTONED}]$"), 50_000).otherwise(0)
    return (intoned + F.when((F.length(c) < 2 * least) & F.lit(extend), padding_us).otherwise(0)).cast("long")


def punctuation_ratio(c: Column) -> Column:
    return count_of(c, CLAUSES) / F.greatest(F.length(c), F.lit(1))


#: A word: letters, digits and connectors, with apostrophes inside.
_W = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"


def led_words(c: Column) -> Column:
    """The text's words, each with the gap before it; only a gap at the end is left out."""
    word = rf"{_W}(?:[\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}']*{_W})?"
    return F.regexp_extract_all(c, F.lit(rf"[^\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}]*+{word}"), F.lit(0))


def without_gap(led: Column) -> Column:
    return F.regexp_replace(led, r"^[^\p{L}\p{Mn}\p{Nd}\p{Pc}]+", "")


def head_rest(c: Column) -> tuple[Column, Column]:
    """First part before a space, and the other parts without separator."""
    parts = F.split(c, " ")
    return F.get(parts, F.lit(0)), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "")


def file_name(c: Column, longest: int = 24) -> Column:
    kept = F.trim(F.regexp_replace(c, "[^a-zA-Z0-9 _-]", ""))
    cut = F.trim(F.left(kept, F.lit(longest)))
    return F.replace(F.when(cut == "", "segment").otherwise(cut), F.lit(" "), F.lit("_"))


def directory_name(c: Column, longest: int = 50) -> Column:
    safe = F.left(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(longest))
    return F.regexp_replace(safe, r"^[_. ]+|[_. ]+$", "")


def extension(url: Column) -> Column:
    """Lower-case extension of a URL's path, '' for none."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def number_or(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def preview(c: Column, longest: int = 50) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.left(c, F.lit(longest)), F.lit("..."))).otherwise(c)


def listed(a: Column) -> Column:
    """Extensions as a line to show: upper case, without dots."""
    return F.array_join(F.transform(a, lambda e: F.upper(F.ltrim(e, F.lit(".")))), ", ")
