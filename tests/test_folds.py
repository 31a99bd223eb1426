"""Folds and state against plain Python, and properties of the segment operators."""

import re

import pytest
from pyspark.sql import functions as F

from strandline.functions import binary, text
from strandline.operators import lexicon, order, segments
from strandline.plans import segments as P
from strandline.sources import readers
from strandline.streaming import frames

SF = "/root/testdata/sf0.001"



def plain_packed(value, longest):
    out, line, size = [], "", 0
    for w in value.split():
        cost = len(w) + (1 if size > 0 else 0)
        if size + cost > longest and size > 0:
            out.append(line)
            line, size = w, cost
        else:
            line, size = (line + " " + w if line else w), size + cost
    return out + ([line] if line else [])


def plain_positioned(value, least=8):
    ends, out, held, start, at = text.ENDINGS, [], "", 0, 0
    for c in value:
        held += c
        at += 1
        t = held.strip(" \t\r\n\f")
        if c in ends and len(t) >= least:
            out.append((t, start, at - 1, len(t)))
            held, start = "", at
    tail = held.strip(" \t\r\n\f")
    if len(tail) >= least:
        out.append((tail, start, at - 1, len(tail)))
    elif out:
        t, a, _, _ = out[-1]
        t = t + " " + tail
        out[-1] = (t, a, at - 1, len(t))
    return out


def test_packed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", text.packed(text.normalise(F.col("text")), 40).alias("p")).collect()
    assert all(r.p == plain_packed(re.sub(r"[ \t\r\n\f]+", " ", r.text), 40) for r in docs)


def test_positioned(spark):
    extra = spark.createDataFrame([("",), ("ab",), ("...",), ("Ends well here. ",), ("Long enough one. no",), ("a.b.c.d.e.f.g.h. tail that is long",)], "text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").union(extra)
    for r in docs.select("text", text.positioned(F.col("text")).alias("p")).collect():
        assert [tuple(x) for x in r.p] == plain_positioned(r.text)


def test_repaired_neighbours_meet(spark):
    rows = segments.repair(P.segment_rows(spark, SF).select("user_id", "seg_no", "s", "e"), "user_id").orderBy("user_id", "seg_no").collect()
    for a, b in zip(rows, rows[1:]):
        if a.user_id == b.user_id:
            assert abs(b.s - a.e) <= 1000 or a.e >= b.s


def test_cuts_keep_every_word(spark):
    df = spark.createDataFrame([(1, 0, 10_000_000, "a b c d e f g h", [500_000, 2_000_000, 2_500_000, 6_000_000]), (2, 0, 5_000_000, "x", [1_500_000])], "id int, s long, e long, text string, cuts array<long>")
    rows = segments.split_at_cuts(df).orderBy("id", "part").collect()
    assert " ".join(r.text for r in rows if r.id == 1) == "a b c d e f g h"
    assert [r.e for r in rows if r.id == 1] == [2_000_000, 6_000_000, 10_000_000]
    assert [(r.s, r.e, r.text) for r in rows if r.id == 2] == [(0, 5_000_000, "x")]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("reach", [1, 2])
def test_suggestions_against_brute_force(spark, tmp_path, reach):
    import random

    r = random.Random(reach)
    make = lambda: "".join(r.choice("abcü") for _ in range(r.randrange(1, 9)))
    words = sorted({make() for _ in range(60)} | {"phone", "fone", "cat", "coat", "lot", "a lot"})
    bad = sorted({make() for _ in range(60)} | {"fon", "fhone", "uber", "alot", "fofo", "x" * 20_000, "cat" * 2000})
    (tmp_path / "rules").write_text("# rules\nREP 3\nREP f ph\nREP alot a_lot\nREP c ab\nSFX A Y 1\n")
    swaps = readers.replacements(spark, str(tmp_path / "rules"))
    pairs = [("f", "ph"), ("alot", "a lot"), ("c", "ab")]
    assert sorted(map(tuple, swaps.collect())) == sorted(pairs)
    forms, known = spark.createDataFrame([(b,) for b in [*bad, None]], "form string"), spark.createDataFrame([(w,) for w in words], "form string")
    got = {(x.bad, x.form, x["class"]) for x in lexicon.suggestions(forms, known, swaps, most=999, reach=reach).collect()}
    want = {(b, w): plain_distance(b, w) for b in bad if len(b) < 100 for w in words if 1 <= plain_distance(b, w) <= reach}
    for b in bad[:]:
        for src, dst in pairs if len(b) < 100 else ():
            made = {b[:k] + dst + b[k + len(src) :] for k in range(len(b)) if b.startswith(src, k)} - {b}
            want |= {(b, w): 0 for w in made & set(words)}
    assert got == {(*k, n) for k, n in want.items()} and len(got) > 50


def test_numbers_over_a_whole_table(spark):
    rows = [(k % 7, k, k % 3) for k in range(500)] + [(None, 500, 1)]
    df = spark.createDataFrame(rows, "a long, id long, n long").repartition(6)
    got, at = order.running(order.numbered(df, "place", "a", "id"), F.col("n"), "before", "a", "id").orderBy("place").collect(), 0
    assert [(r.a, r.id) for r in got] == sorted([(a, k) for a, k, _ in rows], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for place, r in enumerate(got, 1):
        assert (r.place, r.before) == (place, at)
        at += r.n
    assert order.numbered(df.limit(0), "place", "a", "id").count() == 0


def test_cipher_known_answers(spark):
    # AES-256-CBC with PKCS padding, made by another implementation.
    known = {
        "": "38ae83a3edd22a71ecf296539ddf7320",
        "The quick brown ": "3fb71aa5df5cb45088bb79102524e2aba148ab1bd0921a36bed90c3cdae98768",
        "The quick brown fox": "3fb71aa5df5cb45088bb79102524e2abc7078c035faedf007eb212d98060f5f8",
    }
    key, df = "0123456789abcdef0123456789abcdef", spark.createDataFrame([(t,) for t in known], "t string")
    c = F.encode("t", "UTF-8")
    made = df.select("t", F.lower(F.hex(binary.encrypt(c, key, True))).alias("code"), binary.encrypt(c, key).alias("free"), binary.encrypt_head(c, key).alias("head"))
    rows = made.withColumn("back", F.decode(binary.decrypt(F.col("free"), key), "UTF-8")).collect()
    assert {r.t: r.code for r in rows} == known and all(r.back == r.t and r.t.encode() not in bytes(r.free)[16:] or not r.t for r in rows)
    heads = {r.t: r.head and bytes(r.head) for r in rows}
    assert heads == {"": None, "The quick brown ": bytes.fromhex(known["The quick brown "]), "The quick brown fox": bytes.fromhex(known["The quick brown "]) + b"fox"}


def test_listed_files(spark, tmp_path):
    for name, size in (("a.txt", 3), ("b.TXT", 5), ("c.mp3", 7), ("d", 1), (".hidden.txt", 2)):
        (tmp_path / name).write_bytes(bytes(size))
    found = readers.files(spark, str(tmp_path), extensions=(".txt",)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in found) == [("a.txt", 3), ("b.TXT", 5)]
    assert readers.files(spark, str(tmp_path / "not there")).collect() == []


def test_frames_cut_short(spark):
    whole = binary.frame(0xB, 4, 1, F.lit(352), F.encode(F.lit("ab"), "UTF-8"), F.encode(F.lit("xyz"), "UTF-8"))
    df = spark.range(20).select(F.col("id").alias("k"), F.substring(whole, F.lit(1), F.col("id").cast("int")).alias("value"))
    rows = {r.k: r for r in frames.decoded(df).collect()}
    assert rows[3].reason == "no header" and rows[6].reason == "no event" and rows[12].reason == "cut short"
    full = frames.decoded(spark.range(1).select(whole.alias("value"))).first()
    assert (full.event, full.id, bytes(full.payload), full.reason) == (352, "ab", b"xyz", None)


def test_entry_without_llm(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert "pipeline" not in entry.queries() and "T02_sentences" in entry.queries()
