"""Work grows with the rows: plans and results of what was slow on large tables."""

import json

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _above_generate(df):
    """The optimised plan's part that runs for each row of an explode."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan
    return plan[: plan.index("Generate")]


def test_presets_are_tried_once_a_text(spark):
    from strandline.plans.surface import R

    assert "RLIKE" not in _above_generate(R.queries["F03_presets"](spark, SF)).upper()


def test_variants_are_split_once_a_text(spark):
    from strandline.plans.segments import R

    plan = R.queries["A14_best_variant"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # the sentences of one longer_split()


def test_token_positions_move_no_row(spark):
    from strandline.operators import lexicon

    rows = spark.createDataFrame([(1, "It's a 'b'. " * 3000), (2, ""), (3, None)], "doc_id int, text string")
    made = lexicon.tokens(rows, "doc_id")
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    last = made.agg(F.max("end_pos"), F.count("*")).first()
    assert tuple(last) == (12 * 2999 + 9, 9000)


def _operators(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_are_cut_without_folding(spark):
    from strandline.functions import text

    rows = spark.createDataFrame([("Erste Zeile hier。 " * 5000 + "ab",)], "text string")
    packed, placed = rows.select(text.packed(F.col("text")).alias("x")), rows.select(text.positioned(F.col("text")).alias("x"))
    assert "aggregate(" not in _operators(packed)
    assert packed.selectExpr("size(x)", "x[0]").first()[0] == len(packed.first()[0])
    assert max(len(line) for line in packed.first()[0]) <= 80
    out = placed.first()[0]
    assert len(out) == 5000 and (out[1].start_pos, out[1].end_pos) == (17, 34) and out[-1].text == "Erste Zeile hier。 ab" and out[-1].end_pos == 18 * 5000 + 1


def test_a_line_end_of_another_kind_is_no_end_of_text(spark):
    from strandline.functions import text

    rows = spark.createDataFrame([(" a \u0085",)], "text string")
    assert rows.select(text.strip(F.col("text"))).first()[0] == "a \u0085"


def _before_deal(df):
    """What runs on the documents' own partitions, which may be a single one."""
    parts = _operators(df).split("RepartitionByExpression")[1:]
    assert parts
    return [p[: p.index("Relation")] for p in parts if "Relation" in p]


def test_texts_are_dealt_before_they_are_cut(spark):
    from strandline.plans import collected

    for name in ("T02_sentences", "S06_lines", "J01_unknown", "J09_dispatch", "W14_cascade", "W14_refined", "W14_silence"):
        for below in _before_deal(collected()[0][name](spark, SF)):
            assert not any(f in below for f in ("regexp", "RLIKE", "split(", "size(")), name


def test_pieces_are_made_once(spark):
    from strandline.operators.order import unrolled

    rows = spark.createDataFrame([(1, "b,a"), (2, None), (3, "")], "k int, text string").repartition("k")
    made = unrolled(rows, ["k"], F.filter(F.split("text", ","), lambda x: x != ""), "at", "x")
    assert _operators(made).count("split(") == 1
    assert sorted(map(tuple, made.collect())) == [(1, 0, "b"), (1, 1, "a")]


def test_unknown_words_are_counted_before_they_meet_the_dictionary(spark):
    from strandline.plans.lexicon import R

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with a dictionary that is too large for it
    try:
        plan = _operators(R.queries["J01_unknown"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("Join LeftAnti") < plan.index("Aggregate [doc_id")


def test_suggestions_read_the_texts_once(spark):
    from strandline.plans.lexicon import R

    assert not any("documents" in f for f in R.queries["J02_suggest"](spark, SF).inputFiles())


def test_manifests_are_sorted_without_a_comparator(spark):
    from strandline.sources import writers

    rows = spark.createDataFrame([(1, k, f"t{k}", k, k + 1, "f") for k in (2, 0, 1)], "doc_id int, seg_no long, text string, s long, e long, file string")
    made = writers.manifest_json(rows, "doc_id")
    assert "array_sort" not in _operators(made)
    assert [m["index"] for m in json.loads(made.first().manifest)] == [1, 2, 3]


def test_sentences_meet_places_with_and_without_gaps(spark):
    from strandline.operators import align

    said = spark.createDataFrame([(g, k, f"{g}{k}") for g in "ab" for k in range(3)], "g string, seg_no long, text string")
    places = spark.createDataFrame([("a", k) for k in (0, 1, 2, 3)] + [("b", k) for k in (0, 2, 2, 5)], "g string, seg_no long")
    whole = spark.createDataFrame([("a", "x y"), ("b", "x y")], "g string, text string")
    got = sorted(map(tuple, align.merged(said, places, whole, "g").collect()))
    assert got == [("a", 0, "a0"), ("a", 1, "a1"), ("a", 2, "a2"), ("b", 0, "b0"), ("b", 2, "b2")]


def _deals(df):
    """Lines of the plan that move documents' rows."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x and "doc_id" in x]


def test_the_cascade_deals_documents_once(spark):
    from strandline.plans.segments import R

    assert len(_deals(R.queries["W14_refined"](spark, SF))) == 1


def test_groups_without_an_end_keep_their_times(spark):
    from strandline.operators import segments

    rows = [(1, 0, 0, 0, "", None, -800_000), (2, 0, 0, 1_000_000, "a", None, 2_000_000)]
    df = spark.createDataFrame(rows, "g long, seg_no long, s long, e long, text string, cuts array<long>, actual long")
    assert sorted(map(tuple, segments.cascade(df, "g").collect())) == [(1, 0, 0, 0, 0, ""), (2, 0, 0, 2_000_000, 2_000_000, "a")]


def test_clauses_of_plain_and_wide_characters(spark):
    import re

    from strandline.functions import text

    texts = [" a,b . c", "a;; \t!b ", "。，", "x。 y；z,", "ä！\u0085 ,", "", " \n", "no end", "。。 .", "é? ！"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", text.clauses(F.col("t")).alias("c"))
    for t, c in df.collect():
        parts = [p.strip(" \t\r\n\f") for p in re.split("(?<=[,.!?;。！？；])", t)] if t is not None else None
        assert c == (parts and [p for p in parts if p]), t


def test_silences_meet_documents_where_they_lie(spark):
    from strandline.plans.segments import R

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with more cuts than that
    try:
        made = R.queries["W14_silence"](spark, SF)
        assert len(_deals(made)) == 1 and "array_sort" not in _operators(made)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
