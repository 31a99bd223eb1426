r"""Operator 6: personal data and secrets replaced by surrogates, with DataFrame functions only.

Entities are found by one pattern: secrets given by name (a quoted one to its closing quote), e-mail
addresses, IPv4 and IPv6 addresses, phone numbers (international, American, and national ones that start
with 0) and social security numbers, card numbers, IBANs, access keys, long hexadecimal strings, and names
after a title. Each entity has a normal form (lower case, letters and digits); its surrogate is made
from a keyed digest of that, so that all its spellings and mentions agree (coreference):

* digits become digits and letters letters of the same script and case; separators stay;
* octets keep their number of digits and stay valid; a card that passes the Luhn test passes it again;
  top-level domains, country codes and key prefixes stay; hexadecimal stays hexadecimal;
* a name keeps its title; given names and surnames get invented ones of that gender and script.

Secrets, keys and hexadecimal strings reach to the end of their token, however long. Names found with a
title are replaced in the rest of the same text too, where a capitalised word is one of their parts.

Collision checks: two entities of a kind never share a surrogate, and no surrogate is itself an entity
of the tables; whoever fails takes the next attempt. Who fails ATTEMPTS times has a format with few free
values or none: these take the entity that comes next among those of their format, in a keyed order. No
one else has that as a surrogate, so surrogates stay distinct however full a format is.

A given name's gender is that of the titles it stands after anywhere; with none or with both it is
neutral. So a name has one surrogate, whatever its title. Names are found by titles alone.

The join back goes over the list of entities of a text, not over documents: texts without entities do
not move, and equal lists are looked up once. Defined results: null and empty texts stay as they are;
repeated rows are all replaced alike; all columns are kept, a column named n_replaced is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import common
from strandline.operators.order import scanned

ATTEMPTS = 12

_SECRET = r"""(?i:password|passwd|pwd|secret|token|api_?key)\s{0,2}[=:]\s{0,2}["']?"""
#: What a secret's name is followed by: a quoted text to its closing quote; else a token to its end, which
#: after a colon has six characters or a digit, so that prose stays.
_QUOTED = r"""(?<=")[^"\r\n]++(?=")|(?<=')[^'\r\n]++(?=')"""
_BARE_SECRET = r"""(?:(?<==)|(?<==\s)|(?<==\s\s)|(?=[^\s"']{6}|[^\s"'0-9]*[0-9]))[^\s"']++"""
_HEX4 = "[0-9a-fA-F]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLES = {
    "m": "Mr|Herr|Monsieur|Señor|Sr|Господин",
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа",
    "n": "Dr|Prof",
}
_NAME = r"\p{Lu}(?=[\p{L}'’-])\p{L}*+(?:['’-](?!s(?!\p{L}))\p{L}++)*+"
#: Words in which names are looked up that were found with a title elsewhere in the text.
_WORD = r"\p{L}++(?:['’-](?!s(?!\p{L}))\p{L}++)*+"
#: Kinds in the order in which they are tried; each pattern starts where no letter or digit precedes.
KINDS = {
    "secret": _SECRET + f"(?:{_QUOTED}|{_BARE_SECRET})",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}+",
    "ipv6": rf"(?<!:)(?:(?:{_HEX4}:){{7}}{_HEX4}|(?=[a-fA-F:]*+[0-9])(?:{_HEX4}(?::{_HEX4}){{0,6}}::(?:{_HEX4}(?::{_HEX4}){{0,6}})?|::{_HEX4}(?::{_HEX4}){{0,6}}))(?![\p{{L}}\p{{N}}:])",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\(0\) ?)?\(?[0-9]{2,4}\)?(?:[ ./-]?[0-9]{2,4}){2,4}(?![0-9])|(?![0-9]{2}[./-][0-9]{2}[./-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]))(?=0(?:[ ./-]?[0-9]){8,14}(?![0-9]))0[0-9]{1,5}(?:[ ./-][0-9]{2,9})+(?![\p{L}\p{N}])|0[0-9]{9,11}(?![\p{L}\p{N}])|\(0[0-9]{1,5}\)[ -]?[0-9]{2,9}(?:[ -][0-9]{2,9})*(?![\p{L}\p{N}])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "card": r"[0-9]{13,19}(?![0-9])|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}(?![0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "key": r"(?:AKIA|ASIA)[0-9A-Z]{16,}+(?![\p{L}\p{N}])|(?:ghp|gho|sk|pk|xoxb|xoxp)[_-][0-9A-Za-z_-]{16,}+",
    "hex": r"(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{16,}+(?![\p{L}\p{N}])",
    "name": rf"(?:{'|'.join(_TITLES.values())})\.? {_NAME}(?: {_NAME})?",
}
ENTITY = r"(?<![\p{L}\p{N}])(?:" + "|".join(KINDS.values()) + ")"

#: Parts of invented names, by script: beginnings, middles, and endings by gender.
_PARTS = {
    "latin": {
        "head": "bal ben cor dal dor eld fal gar hal jor kel lan mar nor per quin ros sal tor val".split(),
        "middle": "a e i o u an en in or ar el il am em is os".split(),
        "given_m": "do rik to us win mund bert ton lo ric".split(),
        "given_f": "ra lia na belle dette line sa ria linde ta".split(),
        "given_n": "rin lee mar dy ry lyn vay cey ren sey".split(),
        "surname": "ford berg mann sen dale ton well ley ski ner brook stad wick land hart gren".split(),
    },
    "cyrillic": {
        "head": "бал бор вер гор дар зор кал лад мар нор пет рад сав тор яр".split(),
        "middle": "а е и о у ам ен ив ол ор".split(),
        "given_m": "слав мир дан рат вей тин лем гор".split(),
        "given_f": "лина мила рина дана ша вета рия сия".split(),
        "given_n": "ша ся ля ня тя ва жа ка".split(),
        "surname": "ский енко чук вич ман лев дин рус".split(),
    },
}


def _sql_list(words: list[str]) -> str:
    return "array(" + ",".join(f"'{w}'" for w in words) + ")"


def _byte(k: str) -> str:
    return f"cast(conv(substring(stream, 2 * pmod({k}, 128) + 1, 2), 16, 10) as int)"


def _each(text: str, first: str) -> str:
    """SQL: `text` with every letter and digit from position `first` on exchanged."""
    old = f"transform(regexp_extract_all({text}, '(?s).', 0), (c, k) -> struct(c as c, {_byte('(k + 1)')} as b, k + 1 as i))"
    new = """case when length(x.c) = 0 or x.i < {first} then x.c
        when x.c rlike '[0-9]' then cast(pmod(x.b, 10) as string)
        when kind in ('hex', 'hexsecret', 'ipv6') and x.c rlike '[a-f]' then substring('abcdef', pmod(x.b, 6) + 1, 1)
        when x.c rlike '[a-z]' then chr(97 + pmod(x.b, 26))
        when x.c rlike '\\\\p{{IsLatin}}' then substring('àáâäçèéêëìíîïñòóôöùúûü', pmod(x.b, 22) + 1, 1)
        when x.c rlike '\\\\p{{IsCyrillic}}' then substring('абвгдежзиклмнопрстуфхцчшыэюя', pmod(x.b, 28) + 1, 1)
        when x.c rlike '\\\\p{{IsGreek}}' then substring('αβγδεζηθικλμνξοπρστυφχψω', pmod(x.b, 24) + 1, 1)
        when x.c rlike '\\\\p{{IsHan}}' then substring('一丁七万三上下中九二五人六北十千南口四土大天女子小山川工水火', pmod(x.b, 30) + 1, 1)
        when x.c rlike '[\\\\p{{L}}\\\\p{{N}}]' then chr(97 + pmod(x.b, 26)) else x.c end""".format(first=first)
    return f"case when length({text}) > 0 then array_join(transform({old}, x -> {new}), '') else '' end"


def _luhn(text: str, shift: int) -> str:
    """SQL: the Luhn sum of a digit string, `shift` places left of the end."""
    d = f"cast(substring({text}, i, 1) as int)"
    twice = f"pmod(length({text}) - i + {shift}, 2) = 1"
    return f"aggregate(sequence(1, length({text})), 0L, (s, i) -> s + case when {twice} then pmod(2 * {d}, 10) + (2 * {d}) div 10 else {d} end, s -> cast(s as int))"


def _invented(script: str, ending: str) -> str:
    p = _PARTS[script]
    pick = [f"element_at({_sql_list(w)}, pmod({_byte(str(k))}, {len(w)}) + 1)" for k, w in enumerate((p["head"], p["middle"], p["head"], p["middle"], p[ending]))]
    long = f"case when attempt > 2 or pmod({_byte('9')}, 2) = 0 then concat({pick[2]}, {pick[3]}) else '' end"
    # the more attempts, the more syllables: names never run out
    more = f"case when attempt > 4 then array_join(transform(sequence(1, attempt - 4), i -> element_at({_sql_list([a + b for a in p['head'][:6] for b in p['middle'][:6]])}, pmod({_byte('(10 + i)')}, 36) + 1)), '') else '' end"
    return f"concat({pick[0]}, {pick[1]}, {long}, {more}, {pick[4]})"


def _surrogate() -> str:
    """SQL over kind, norm, attempt and stream: the surrogate of a normal form."""
    octets = "array_join(transform(sequence(0, 3), i -> case length(split(norm, '[.]')[i]) when 1 then cast(pmod({b}, 10) as string) when 2 then cast(10 + pmod({b}, 90) as string) else cast(100 + pmod({b}, 156) as string) end), '.')".format(b=f"({_byte('2 * i')} * 256 + {_byte('2 * i + 1')})")
    card = f"(case when pmod({_luhn('norm', 0)}, 10) = 0 then concat({{s}}, cast(pmod(10 - pmod({_luhn('{s}', 1)}, 10), 10) as string)) else {_each('norm', '1')} end)"
    card = card.replace("{s}", f"({_each('substring(norm, 1, length(norm) - 1)', '1')})")
    names = " ".join(f"when kind = '{e}' and norm rlike '^\\\\p{{Is{s.capitalize()}}}' then {_invented(s, e)}" for s in _PARTS for e in ("given_m", "given_f", "given_n", "surname"))
    return f"""case when kind = 'ip' then {octets}
        when kind = 'card' then {card}
        when kind = 'email' then concat({_each("regexp_extract(norm, '^(.*)[.][^.]*$', 1)", '1')}, '.', substring_index(norm, '.', -1))
        when kind = 'phone' then {_each('norm', 'greatest(1, length(norm) - 9)')}
        when kind = 'key' then {_each('norm', "case when norm like 'a_ia%' then 5 else 3 end")}
        when kind = 'iban' then {_each('norm', '3')}
        {names}
        else {_each('norm', '1')} end"""


def _parts(surfaces: DataFrame) -> DataFrame:
    """surface -> rows (surface, prefix, body, place, kind, norm); a name has a row a word."""
    tests = KINDS | {"secret": _SECRET + "(?s:.+)"}  # a quoted one is without its closing quote here
    first = F.coalesce(*[F.when(F.col("surface").rlike(rf"^(?:{p})$"), F.lit(k)) for k, p in tests.items()])
    prefix = (
        F.when(F.col("kind") == "secret", F.regexp_extract("surface", "^" + _SECRET, 0))
        .when(F.col("kind") == "name", F.regexp_extract("surface", rf"^(?:{'|'.join(_TITLES.values())})\.? ", 0))
        .otherwise("")
    )
    gender = F.coalesce(*[F.when(F.col("prefix").rlike(rf"^(?:{p})\.? $"), F.lit(g)) for g, p in _TITLES.items()], F.lit("n"))
    rows = surfaces.withColumn("kind", first).withColumn("prefix", prefix).withColumn("body", F.expr("substring(surface, length(prefix) + 1)"))
    rows = rows.withColumn("words", F.when(F.col("kind") == "name", F.split("body", " ")).otherwise(F.array("body")))
    rows = rows.withColumn("gender", gender).select("surface", "prefix", "kind", "gender", F.size("words").alias("n"), F.posexplode("words").alias("place", "body"))
    kind = (
        F.when(F.col("kind") == "name", F.when(F.col("place") == F.col("n") - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), "gender")))
        .when((F.col("kind") == "secret") & F.col("body").rlike("^[0-9a-fA-F]+[^0-9a-zA-Z]*$"), F.lit("hexsecret"))
        .otherwise(F.col("kind"))
    )
    plain = F.lower(F.regexp_replace("body", r"^[^\p{L}\p{N}:]+", ""))
    norm = F.when(F.col("kind").isin("email", "ip", "ipv6"), plain).otherwise(F.lower(F.regexp_replace("body", r"[^\p{L}\p{N}]", "")))
    return rows.select("surface", "prefix", "place", "body", kind.alias("kind"), norm.alias("norm"))


def _settled(parts: DataFrame) -> DataFrame:
    """Parts whose given names have one gender each."""
    given = parts.filter("kind like 'given%'").groupBy("norm").agg(F.min(F.when(F.col("kind") != "given_n", F.col("kind"))).alias("low"), F.max(F.when(F.col("kind") != "given_n", F.col("kind"))).alias("high"))
    one = given.select("norm", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("given_n").alias("settled"))
    others, names = parts.filter("kind not like 'given%'"), parts.filter("kind like 'given%'").join(one, "norm")
    return others.unionByName(names.select("surface", "prefix", "place", "body", F.col("settled").alias("kind"), "norm"))


def _streamed(rows: DataFrame, key: str) -> DataFrame:
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "norm", F.col("attempt").cast("string"))
    stream = F.concat(*[F.sha2(F.concat_ws("\x1f", seed, F.lit(str(k))), 256) for k in range(4)])
    return rows.withColumn("stream", stream).withColumn("surrogate", F.expr(_surrogate())).drop("stream")


def assign(norms: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, norm) -> surrogate, distinct within its kind and no entity itself; written."""
    now = common.written(_streamed(norms.withColumn("attempt", F.lit(0)), key), "surrogates")
    real = norms.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
    turn = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "norm"))
    for _ in range(ATTEMPTS):
        judged = now.withColumn("turn", turn).join(real, ["kind", "surrogate"], "left")
        judged = common.written(judged.withColumn("bad", (F.col("turn") > 1) | F.col("real").isNotNull()).select("kind", "norm", "attempt", "surrogate", "bad"), "surrogates")
        common.drop_written(now)
        if judged.filter("bad").isEmpty():
            return judged.drop("bad")
        again = _streamed(judged.filter("bad").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), key)
        now = common.written(judged.filter("not bad").select("kind", "norm", "attempt", "surrogate").unionByName(again), "surrogates")
    # a full format: these take the next entity of their format (if there is another one)
    turned = F.regexp_replace(F.regexp_replace("norm", r"\p{Nd}", "0"), r"\p{L}", "a")
    shaped = judged.withColumn("shape", F.when(F.col("kind") == "email", F.concat(turned, F.substring_index("norm", ".", -1))).when(F.col("kind").isin("phone", "iban", "key"), F.concat(F.substring("norm", 1, 4), turned)).otherwise(turned))
    full = shaped.filter("bad").select("kind", "shape").distinct()
    ring = shaped.join(full, ["kind", "shape"]).select("kind", "shape", "norm", F.sha2(F.concat_ws("\x1f", F.lit(key), "norm"), 256).alias("place"))
    first = ring.groupBy("kind", "shape").agg(F.min_by("norm", F.struct("place", "norm")).alias("first"))
    after = scanned(ring, ["kind", "shape"], ["place", "norm"], next=("after", F.col("norm"))).join(first, ["kind", "shape"])
    after = after.select("kind", "norm", F.coalesce("next", "first").alias("next"))
    ended = judged.join(after, ["kind", "norm"], "left").select("kind", "norm", "attempt", F.when(F.col("bad"), F.col("next")).otherwise(F.col("surrogate")).alias("surrogate"))
    return common.written(ended, "surrogates")


def _filled() -> str:
    """SQL over body, kind and surrogate: the surrogate in the body's format and case."""
    runs = r"regexp_extract_all(body, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+', 0)"
    plain = r"regexp_extract_all(regexp_replace(surrogate, '[^\\p{L}\\p{N}]', ''), '(?s).', 0)"
    cased = "array_join(zip_with(slice(x.plain, x.k + 1, length(g)), regexp_extract_all(g, '(?s).', 0), (p, c) -> case when c <> lower(c) then upper(p) else p end), '')"
    put = rf"case when g rlike '^[\\p{{L}}\\p{{N}}]' then named_struct('out', concat(x.out, {cased}), 'k', x.k + length(g), 'plain', x.plain) else named_struct('out', concat(x.out, g), 'k', x.k, 'plain', x.plain) end"
    shaped = f"aggregate({runs}, named_struct('out', '', 'k', 0, 'plain', {plain}), (x, g) -> {put}, x -> x.out)"
    named = "case when body = upper(body) and length(body) > 1 then upper(surrogate) else initcap(surrogate) end"
    # without a letter or digit there is nothing to fill in
    return f"case when kind like 'given%' or kind = 'surname' then {named} when norm = '' then repeat('x', length(body)) else {shaped} end"


def _bare(gaps: str) -> str:
    """SQL over names__: the texts between entities with their capitalised words that are known names
    replaced, and the number of those. A word of several parts is looked up whole, then by its parts."""
    norm = r"lower(regexp_replace({w}, '[^\\p{{L}}\\p{{N}}]', ''))"
    name = "case when {w} = upper({w}) and length({w}) > 1 then upper(names__[{n}]) else initcap(names__[{n}]) end"
    hit = "{w} rlike '^\\\\p{{Lu}}' and names__[{n}] is not null"

    def looked(w: str, other: str) -> str:
        n = norm.format(w=w)
        return f"case when {hit.format(w=w, n=n)} then named_struct('text', {name.format(w=w, n=n)}, 'n', 1) else {other} end"

    parts = f"transform(regexp_extract_all(w, '\\\\p{{L}}+|[^\\\\p{{L}}]+', 0), p -> {looked('p', "named_struct('text', p, 'n', 0)")})"
    joined = "named_struct('text', array_join(transform({a}, y -> y.text), ''), 'n', aggregate({a}, 0, (s, y) -> s + y.n))"
    single = "named_struct('text', w, 'n', 0)"
    word = looked("w", f"case when w rlike '^\\\\p{{L}}' and w rlike '[^\\\\p{{L}}]' then {joined.format(a=parts)} else {single} end")
    pattern = (_WORD + r"|[^\p{L}]++").replace("\\", "\\\\")
    pieces = f'transform(regexp_extract_all(g, "{pattern}", 0), w -> {word})'
    return f"transform({gaps}, g -> {joined.format(a=pieces)})"


def replace(docs: DataFrame, key: str = "set a key of your own", text: str = "text") -> DataFrame:
    """docs with the entities in column `text` replaced, and n_replaced, their number."""
    given = docs.columns
    others = F.struct(*[F.col(f"`{c}`") for c in given if c not in (text, "n_replaced")] or [F.lit(0).alias("none")]).alias("row__")
    docs = docs.select(others, F.col(f"`{text}`").alias("text__"))  # no column of docs clashes with those made here
    found = F.coalesce(F.regexp_extract_all(F.col("text__"), F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>"))
    marked = docs.withColumn("entities__", found)
    marked = common.written(marked.withColumn("list__", F.when(F.size("entities__") > 0, F.sha2(F.array_join("entities__", "\x1f"), 256))), "entities")
    some = marked.filter("list__ is not null")
    lists = some.select("list__", "entities__").groupBy("list__").agg(F.any_value("entities__").alias("entities__"))
    lists = common.written(lists, "entity-lists")
    parts = common.written(_settled(_parts(lists.select(F.explode("entities__").alias("surface")).distinct())), "entity-parts")
    chosen = assign(parts.select("kind", "norm").distinct(), key)
    words = parts.join(chosen, ["kind", "norm"])
    named = words.filter("kind = 'surname' or kind like 'given%'").select("surface", "kind", "norm", "surrogate")
    words = words.select("surface", "prefix", "place", F.expr(_filled()).alias("made"))
    made = words.groupBy("surface", "prefix").agg(F.array_sort(F.collect_list(F.struct("place", "made"))).alias("made"))
    made = common.written(made.select("surface", F.concat("prefix", F.array_join(F.expr("made.made"), " ")).alias("made")), "entity-surrogates")
    at = lists.select("list__", F.posexplode("entities__").alias("place", "surface")).join(made, "surface")
    rows = at.groupBy("list__").agg(F.expr("transform(array_sort(collect_list(struct(place, made))), x -> x.made)").alias("made__"))
    # names of a text by normal form, a surname before a given name of the same form
    known = lists.select("list__", F.explode("entities__").alias("surface")).distinct().join(named, "surface")
    known = known.groupBy("list__", "norm").agg(F.max(F.struct("kind", "surrogate")).alias("best"))
    known = known.groupBy("list__").agg(F.map_from_entries(F.collect_list(F.struct("norm", "best.surrogate"))).alias("names__"))
    rows = rows.join(known, "list__", "left")
    gaps = F.split(F.col("text__"), ENTITY, -1)
    bare = F.when(F.col("names__").isNull(), F.transform("gaps__", lambda g: F.struct(g.alias("text"), F.lit(0).alias("n")))).otherwise(F.expr(_bare("gaps__")))
    joined = F.expr("array_join(transform(sequence(0, size(made__)), i -> concat(get(gaps__, i).text, coalesce(get(made__, i), ''))), '')")
    out = lambda t: [t.alias(c) if c == text else F.col("row__")[c].alias(c) for c in given if c != "n_replaced"]
    changed = some.join(rows, "list__").withColumn("gaps__", gaps).withColumn("gaps__", bare).select(*out(joined), F.expr("size(made__) + aggregate(gaps__, 0L, (n, g) -> n + g.n)").alias("n_replaced"))
    same = marked.filter("list__ is null").select(*out(F.col("text__")), F.lit(0).cast("long").alias("n_replaced"))
    return changed.unionByName(same)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document with its text after replacement."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, key="strandline").select("doc_id", "n_replaced", "text")
