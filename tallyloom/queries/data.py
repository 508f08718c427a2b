"""The driver's tables as surveys, and the same in SQL.

lineitem: returnflag and linestatus are singles, quantity is a number, the
discount makes a weight. orders: an order's distinct return flags are a set. A
user's distinct event types are another. Three banded numbers are a grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import Meta
from ..survey import Survey

FLAGS, STATUS = {"A": 1, "N": 2, "R": 3}, {"F": 1, "O": 2, "P": 3}
PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
EVENTS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def coded(column: str, codes: dict[str, int]) -> F.Column:
    return F.coalesce(*[F.when(F.col(column) == t, F.lit(c)) for t, c in codes.items()])


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> Survey:
    """rf (3 codes), ls (2 codes), qty, disc, price, w; seg 1..4 with nulls."""
    df = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("num"),
        coded("l_returnflag", FLAGS).alias("rf"),
        coded("l_linestatus", STATUS).alias("ls"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"),
        (F.col("l_discount") * 10 + 0.5).alias("w"),
        F.when(F.pmod("l_suppkey", F.lit(5)) > 0, F.pmod("l_suppkey", F.lit(5)).cast("int")).alias("seg"),
        F.col("l_shipdate").alias("ship"),
    )
    meta = Meta(name="lines")
    meta.add("rf", "single", "Return flag", [(c, t) for t, c in FLAGS.items()])
    meta.add("ls", "single", "Line status", [(1, "F"), (2, "O")])
    meta.add("seg", "single", "Segment", [(i, f"segment {i}") for i in range(1, 5)])
    for n, kind in (("okey", "int"), ("num", "int"), ("qty", "float"), ("disc", "float"), ("price", "float"), ("tax", "float"), ("w", "float")):
        meta.add(n, kind, n)
    meta.add("ship", "date", "Shipped")
    return Survey(df, meta)


LINES = """lines AS (SELECT l_orderkey AS okey, l_linenumber AS num,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS rf,
  CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS ls, l_quantity AS qty, l_discount AS disc, l_extendedprice AS price,
  l_tax AS tax, l_discount * 10 + 0.5 AS w, nullif(CAST(l_suppkey % 5 AS INT), 0) AS seg, l_shipdate AS ship FROM lineitem)"""


def orders(spark: SparkSession, sf: str) -> Survey:
    """okey, prio (5 codes), st (3 codes), flags (a set of 3 codes, null without lines), w; total."""
    flags = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_set(coded("l_returnflag", FLAGS))).alias("flags"))
    df = read(spark, sf, "orders").join(flags, F.col("o_orderkey") == F.col("k"), "left")
    df = df.select(
        F.col("o_orderkey").alias("okey"),
        F.col("o_custkey").alias("ckey"),
        coded("o_orderpriority", PRIORITY).alias("prio"),
        coded("o_orderstatus", STATUS).alias("st"),
        "flags",
        F.col("o_totalprice").alias("total"),
        (F.pmod("o_orderkey", F.lit(4)) * 0.5 + 0.25).alias("w"),
    )
    meta = Meta(name="orders")
    meta.add("prio", "single", "Priority", [(c, t) for t, c in PRIORITY.items()])
    meta.add("st", "single", "Status", [(c, t) for t, c in STATUS.items()])
    meta.add("flags", "delimited set", "Return flags", [(c, t) for t, c in FLAGS.items()])
    for n, kind in (("okey", "int"), ("ckey", "int"), ("total", "float"), ("w", "float")):
        meta.add(n, kind, n)
    return Survey(df, meta)


ORDERS = """flagged AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END)) AS flags FROM lineitem GROUP BY 1),
ord AS (SELECT o_orderkey AS okey, o_custkey AS ckey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS prio,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS st, flags, o_totalprice AS total, CAST((o_orderkey % 4) * 0.5 + 0.25 AS DOUBLE) AS w
  FROM orders LEFT JOIN flagged ON o_orderkey = k)"""


def users(spark: SparkSession, sf: str) -> Survey:
    """A row for each user: acts (set of event types with value over 60), top (first of them), n."""
    e = read(spark, sf, "events").withColumn("a", coded("event_type", EVENTS))
    df = e.groupBy("user_id").agg(F.sort_array(F.collect_set(F.when(F.col("value") > 150, F.col("a")))).alias("acts"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    df = df.withColumn("acts", F.when(F.size("acts") > 0, F.col("acts")))
    meta = Meta(name="users")
    meta.add("acts", "delimited set", "Acts", [(c, t) for t, c in EVENTS.items()])
    for n, kind in (("user_id", "int"), ("n", "int"), ("total", "float")):
        meta.add(n, kind, n)
    return Survey(df, meta)


USERS = """users AS (SELECT user_id, nullif(list_sort(list(DISTINCT a) FILTER (WHERE value > 150)), []) AS acts, count(*) AS n, sum(value) AS total
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS a FROM events) GROUP BY 1)"""


def grid(spark: SparkSession, sf: str) -> Survey:
    """g: three items of codes 1..3 (some null), of parts: size, price and key in thirds."""
    third = lambda c: F.when(c > 0, c).cast("int")
    df = read(spark, sf, "part").select(
        F.col("p_partkey").alias("pkey"),
        third(F.pmod("p_size", F.lit(4))).alias("g_1"),
        third(F.pmod(F.floor("p_retailprice"), F.lit(4))).alias("g_2"),
        third(F.pmod("p_partkey", F.lit(4))).alias("g_3"),
        (F.pmod("p_size", F.lit(2)) + 1).cast("int").alias("half"),
        F.col("p_size").alias("size"),
    )
    meta = Meta(name="grid")
    meta.add("g", "single", "Ratings", [(1, "low"), (2, "mid"), (3, "high")], ["size", "price", "key"])
    meta.add("half", "single", "Half", [(1, "even"), (2, "odd")])
    meta.add("pkey", "int", "pkey")
    meta.add("size", "int", "size")
    return Survey(df, meta)


GRID = """grid AS (SELECT p_partkey AS pkey, nullif(CAST(p_size % 4 AS INT), 0) AS g_1, nullif(CAST(CAST(floor(p_retailprice) AS BIGINT) % 4 AS INT), 0) AS g_2,
  nullif(CAST(p_partkey % 4 AS INT), 0) AS g_3, CAST(p_size % 2 + 1 AS INT) AS half, p_size AS size FROM part)"""
