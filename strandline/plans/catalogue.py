"""Queries of the catalogue job, counts and orderings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import catalogue as C
from strandline.operators.order import numbered
from strandline.plans.base import Registry, table
from strandline.plans.segments import _SPLITTABLE

R = Registry()
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'failed' ELSE 'skipped' END"


def _status():
    s = F.col("o_orderstatus")
    return F.when(s == "F", "ok").when(s == "P", "failed").otherwise("skipped")


def _orders(spark, d):
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    return table(spark, d, "orders").withColumn("at_us", us)


@R.add("A01_groups", "SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY o_custkey) AS ordinal FROM orders GROUP BY o_custkey")
def groups(spark, d):
    return C.grouped(table(spark, d, "orders"), "o_custkey")


@R.add("A02_outcomes", f"""SELECT coalesce(o_custkey, -1) AS o_custkey, count(*) AS n, count(*) FILTER (st = 'ok') AS ok, count(*) FILTER (st = 'failed') AS failed, count(*) FILTER (st = 'skipped') AS skipped, max(at_us) - min(at_us) AS span
    FROM (SELECT *, {_STATUS} AS st, epoch_us(o_orderdate) AS at_us FROM orders) GROUP BY ROLLUP (o_custkey)""")
def outcomes(spark, d):
    rows = C.outcomes(_orders(spark, d), "o_custkey", _status(), "at_us")
    return rows.withColumn("o_custkey", F.coalesce("o_custkey", F.lit(-1).cast("long")))


@R.add("A03_totals", "SELECT sum(n)::BIGINT AS segments, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def totals(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    done = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.sum("n").alias("segments"), F.count_if(done).alias("succeeded"), F.count_if(~done).alias("failed"))


_NAMED = "SELECT e.*, coalesce(c.c_name, '<unknown>') AS owner FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id"


def named(spark, d):
    lookup = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("owner"))
    return C.looked_up(table(spark, d, "events"), lookup, "user_id", "owner", "<unknown>")


@R.add("J04_lookup", f"SELECT event_id, owner FROM ({_NAMED})")
def lookup(spark, d):
    return named(spark, d).select("event_id", "owner")


@R.add("A04_top", f"SELECT owner, count(*) AS n FROM ({_NAMED}) WHERE starts_with(event_type, 'c') OR starts_with(event_type, 'p') GROUP BY owner ORDER BY n DESC, owner LIMIT 30")
def top(spark, d):
    e = F.col("event_type")
    return C.top(named(spark, d).filter(e.startswith("c") | e.startswith("p")), "owner")


@R.add("A05_sample", """WITH f AS (SELECT user_id, min((ts, event_id)) AS first FROM events GROUP BY 1), l AS (SELECT max(first) AS last, count(*) AS held FROM (SELECT first FROM f ORDER BY first LIMIT 100))
    SELECT user_id, count(*) AS n FROM events, l WHERE held < 100 OR (ts, event_id) <= last GROUP BY user_id""")
def sample(spark, d):
    return C.bounded_sample(table(spark, d, "events"), "user_id", "ts", "event_id", most=100)


@R.add("J11_attach", "SELECT o_orderkey, pieces FROM orders JOIN (SELECT l_orderkey, count(*) AS pieces FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def attach(spark, d):
    pieces = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.attached(table(spark, d, "orders").select("o_orderkey"), pieces, "o_orderkey")


@R.add("O01_sorted", "SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part")
def ordered(spark, d):
    return numbered(table(spark, d, "part").select("p_name", "p_partkey"), "place", "p_name", "p_partkey")


@R.add("O02_top_keys", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 30")
def top_keys(spark, d):
    return C.top(table(spark, d, "events"), "user_id")


@R.add("O03_top_five", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5")
def top_five(spark, d):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return table(spark, d, "events").withColumn("r", r).filter("r <= 5").select("user_id", "event_id", "value")


@R.add("F03_batch", f"SELECT lang, count(*) AS n, count(*) FILTER ({_SPLITTABLE}) AS split, count(*) FILTER (NOT {_SPLITTABLE}) AS kept FROM documents GROUP BY lang")
def batch(spark, d):
    s = text.splittable(F.col("text"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(s).alias("split"), F.count_if(~s).alias("kept"))
