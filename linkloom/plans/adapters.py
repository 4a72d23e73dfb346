"""Test tables as the edges, items and names that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table


def node(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def key_edges(spark: SparkSession, folder: str, items: bool = True) -> DataFrame:
    """(src, dst): orders to customers and parts, customers and suppliers to nations, nations to regions, parts' suppliers."""
    t = lambda name: read_table(spark, folder, name)
    out = t("orders").select(node("O", "o_orderkey").alias("src"), node("C", "o_custkey").alias("dst"))
    out = out.union(t("customer").select(node("C", "c_custkey"), node("N", "c_nationkey")))
    out = out.union(t("supplier").select(node("S", "s_suppkey"), node("N", "s_nationkey")))
    out = out.union(t("nation").select(node("N", "n_nationkey"), node("R", "n_regionkey")))
    if items:
        lines = t("lineitem")
        out = out.union(lines.select(node("O", "l_orderkey"), node("P", "l_partkey"))).union(lines.select(node("O", "l_orderkey"), node("S", "l_suppkey")))
    return out


KEY_EDGES_SQL = """
SELECT 'O' || o_orderkey AS src, 'C' || o_custkey AS dst FROM orders
UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation"""
ITEM_EDGES_SQL = KEY_EDGES_SQL + """
UNION ALL SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem
UNION ALL SELECT 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem"""


def event_steps(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst): what a user does after what, per week of the year."""
    from pyspark.sql import Window

    events = read_table(spark, folder, "events")
    later = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.withColumn("next", F.lead("event_id").over(later)).withColumn("u", F.col("event_id") % 97).where("next is not null")
    return steps.select(F.concat(F.lit("e"), F.col("u").cast("string")).alias("src"), F.concat(F.lit("e"), (F.col("next") % 97).cast("string")).alias("dst"))
