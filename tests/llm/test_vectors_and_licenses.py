"""Hard negatives, whitening and license scans: against SQL, plain versions, and odd rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import licenses, negatives, queries, whitening

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_licenses"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = plain(df.collect())
    assert got == plain(db.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()) and got


@pytest.mark.parametrize("dim", [1, 7, 8, 64])
@pytest.mark.parametrize("size", [1, 200, 1 << 20, 1 << 40, 1 << 61])
def test_table_scores_are_inner_products(dim, size):
    r = np.random.default_rng(dim)
    a, x = r.integers(-size, size, (5, dim), endpoint=True), r.integers(-size, size, (33, dim), endpoint=True)
    planes = negatives.bit_planes(x)
    sums = negatives.subset_sums(a)
    for tables in (sums, negatives._narrow(sums, len(planes))):
        assert (negatives.scores(tables, planes).astype(np.int64) == x @ a.T).all()  # both wrap


def plain_negatives(rows, positives=5, most=10):
    """rows: id, label, vector, anchor."""
    out = []
    for a, la, va, anchor in rows:
        if not anchor:
            continue
        met = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v, _ in rows if i != a and len(v) == len(va)]
        for p, pid in sorted((s, i) for s, i, label in met if label == la)[:positives]:
            found = sorted((s, i) for s, i, label in met if label != la and 30 * -p <= 100 * -s <= 90 * -p)
            out += [(a, pid, k, i, -p, -s) for k, (s, i) in enumerate(found[:most], 1)]
    return sorted(out)


def test_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "AT_ONCE", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    monkeypatch.setattr(negatives, "CANDIDATES", 32)
    r = np.random.default_rng(3)
    rows = [(int(k), int(r.integers(3)) if k % 3 else 1, [float(v) for v in r.integers(-2, 5, 3 + k % 2)]) for k in range(150)]  # small numbers: many ties
    odd = [(None, 1, [1.0] * 3), (200, None, [1.0] * 3), (201, 1, None), (202, 1, [1.0, None, 2.0]), (203, 1, [float("inf"), 1.0, 1.0]), (7, 2, [99.0, 9.0, 9.0, 9.0]), (204, 1, []), (205, 0, [])]
    df = spark.createDataFrame([(*t, "x") for t in rows + odd], "vec_id long, label int, embedding array<double>, score string").repartition(5)
    got = negatives.mine(negatives.prepared(df, F.col("label"), scale=1), F.col("vec_id") % 4 == 0)
    want = plain_negatives([(k, label, [int(x) for x in v], k % 4 == 0) for k, label, v in rows])
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    assert negatives.mine(negatives.prepared(df.limit(0), F.col("label")), F.col("vec_id") % 4 == 0).count() == 0
    few = negatives.mine(negatives.prepared(df.filter("vec_id in (8, 12)"), F.lit(1)), F.lit(True))
    assert few.count() == 0


def test_whitening_against_eigenvectors(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in vectors[i]] for i in ids]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = np.array([[n * a - b for a, b in zip(row, sums)] for row in x], object)
    c = d.astype(float) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order[:32]]
    got = queries.QUERIES["op12_whitening"](spark, SF)
    assert got.dtypes[:7] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = got.toPandas()
    assert len(got) == 32 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    white = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = c @ axes / np.sqrt(values[:32])
    assert np.abs(white - want * np.sign((white * want).sum(0))).max() < 1e-9
    one = got.drop_duplicates("vec_id").set_index("vec_id").loc[ids]
    assert one.deviation.tolist() == (d * d).sum(1).tolist()
    share = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.abs(share / (values[:32] / values.sum()) - 1).max() < 1e-9


def test_whitening_of_ill_conditioned_columns(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 6)) * 10.0 ** np.arange(6)
    x[:, 3] = x[:, 5] * 1.5 + r.normal(size=400) * 0.05
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = whitening.whiten(whitening.prepared(df.repartition(7))).toPandas()
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(white.T @ white / 400 - np.eye(6)).max() < 1e-8 and got.identity_error.max() < 1e-8


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.0, 0.5]), (2, [1.0, 2.0, 0.5]), (3, [1.5, 3.0, 0.5]), (None, [0.0, 0.0, 0.5]), (5, None), (6, [None, 1.0, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, []), (9, [1.0]), (10, [1e300, 2.0])]
    df = spark.createDataFrame([(*t, 1) for t in rows], "vec_id long, embedding array<double>, n int")
    got = whitening.whiten(whitening.prepared(df)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted([(k, c) for k in (0, 1, 2, 2, 3) for c in (1, 2, 3)] + [(9, 1), (10, 1), (10, 2)])
    assert all((r.whitened is None) == (r.explained == 0) for r in got) and {r.n for r in got if r.vec_id in (1, None)} == {5}
    assert {r.whitened is None for r in got if r.component == 1 and r.vec_id in (1, 2, 3)} == {False}
    assert whitening.whiten(whitening.prepared(df.limit(0))).count() == 0


MADE = (("x", "red green blue black white"), ("y", "one two three four five six seven eight nine ten"), ("x", "RED, green; blue yellow and black"))


def plain_labels(text, templates, percent):
    import re

    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    w, labels, best = re.findall(licenses.WORDS, low(text or "")), set(), 0.0
    for label, notice in templates:
        t = re.findall(licenses.WORDS, low(notice))
        for s in range(0, len(w), len(t)):
            share = len(set(t) & set(w[s : s + 2 * len(t)]))
            if 100 * share >= percent * len(set(t)):
                labels.add(label)
                best = max(best, share / len(set(t)))
    return ",".join(sorted(labels)), best


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_every_block_is_found(spark, monkeypatch, percent):
    import random

    monkeypatch.setattr(licenses, "PIECE", 64)
    r = random.Random(percent)
    some = "red green blue black white one two three four five six seven eight nine ten yellow and zzz Kelvin É é".split()
    texts = [r.choice(["", " ", "-- "]) + r.choice([" ", ". ", "\n"]).join(r.choice(some[: r.randrange(3, len(some))]) for _ in range(r.randrange(400))) for _ in range(120)]
    texts += [None, "", " \n", "ten", "One-two THREE four/five six seven eight nine ten", "red " * 5000, " ".join(some) * 300]
    rows = list(enumerate(texts)) + [(None, "red green blue black white"), (3, texts[3])]
    df = spark.createDataFrame([(*t, "w", "s") for t in rows], "doc_id long, text string, words string, score string").repartition(5)
    got = licenses.scan(df, MADE, percent, {"one two": "p"}).collect()
    want = []
    for d, t in rows:
        labels, best = plain_labels(t, MADE, percent)
        w = " ".join(plain_words(t))
        base = w.split(" ") if w else []
        at = [k for k in range(len(base) - 1) if base[k : k + 2] == ["one", "two"]]
        want.append((d, len(base), len(at), min(at, default=None), max(at, default=None), "p" if at else "", ",".join(sorted({*filter(None, labels.split(",")), *(["p"] if at else [])})), 1.0 if at else best))
    assert plain(got) == plain(want)
    assert licenses.scan(df.limit(0), MADE).count() == 0


def plain_words(text):
    import re

    return re.findall(licenses.WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_notices_give_their_labels_and_prose_none(spark):
    df = spark.createDataFrame([(k, "Some words before it. " * 9 + "\n * ".join(t.split(" ")) + " and after.") for k, (_, t) in enumerate(licenses.TEMPLATES)] + [(-1, "The rights of the public to use the work are granted by law, free of charge or not. " * 5)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(df).collect()}
    assert all(label in got[k] for k, (label, _) in enumerate(licenses.TEMPLATES)) and got[-1] == [""]
    spans = {(r.doc_id, r.template): (r.start, r.end) for r in licenses.blocks(df).collect() if r.overlap == r["size"]}
    assert all(spans[k, k][0] <= 36 < spans[k, k][1] for k in range(len(licenses.TEMPLATES)))
