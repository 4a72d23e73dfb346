"""Rows by key, and unions of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key, in a stated order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def last_by_key(df: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """The last rows of each key, in a stated order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where(F.col("_k") <= count).drop("_k")


def top(df: DataFrame, order: list[str | Column], count: int) -> DataFrame:
    """The first rows in a stated order; 0 is all of them."""
    return df.orderBy(*order).limit(count) if count else df


def graph_union(graphs: list[DataFrame]) -> DataFrame:
    """References of several graphs; where a file is in several, its (specifier, line) of the earliest graph counts.

    Rows that repeat within one graph are kept: only those of later graphs give way.
    """
    out = None
    for k, g in enumerate(graphs):
        g = g.withColumn("graph_seq", F.lit(k))
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    earliest = F.min("graph_seq").over(Window.partitionBy("src", "specifier", "line"))
    return out.withColumn("_first", earliest).where("graph_seq = _first").drop("_first")


def findings(reports: dict[str, DataFrame]) -> DataFrame:
    """One table of findings, kind telling them apart."""
    out = None
    for kind, df in reports.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def count_kinds(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").cast("bigint").alias("n"))
