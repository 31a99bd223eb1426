"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from strandline import plans

SF = "/root/testdata/sf0.001"

QUERIES, SQL = plans.collected()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(round(v, 5) if isinstance(v, float) else str(v) if v is not None else "" for v in r) for r in df.astype(object).where(df.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_all_documents_take_part(spark, db):
    docs = db.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert QUERIES["W07_cut_split"](spark, SF).select("doc_id").distinct().count() == docs
    forms = {r.form for r in QUERIES["J01_unknown"](spark, SF).select("form").distinct().collect()}
    known = {r.bad for r in QUERIES["J02_suggest"](spark, SF).select("bad").distinct().collect()}
    talk = " ".join(r[0] or "" for r in db.execute("SELECT text FROM conversations").fetchall()).lower()
    assert known <= forms and any(w not in talk for w in known)
