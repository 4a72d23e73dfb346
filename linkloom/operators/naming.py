"""Naming conventions of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import casing, casing_fits_export, confidence, discriminating, name_words, round_half_up, to_casing

SIBLINGS, SHARE = 3, 0.6


def majority(names: DataFrame, group: str = "dir", value: str = "casing", *, least_rows: int = SIBLINGS, share: float = SHARE) -> DataFrame:
    """(group, value, n, total, share): the mode of each group if it is alone in front, on enough rows and a large enough share.

    Values of ``unknown`` count in the total but can't win.
    """
    counted = names.groupBy(group, value).agg(F.count("*").cast("bigint").alias("n"))
    total = counted.groupBy(group).agg(F.sum("n").cast("bigint").alias("total"))
    place = Window.partitionBy(group).orderBy(F.desc("n"))
    front = counted.where(F.col(value) != "unknown").withColumn("place", F.rank().over(place)).where("place = 1")
    alone = front.withColumn("ties", F.count("*").over(Window.partitionBy(group))).where("ties = 1")
    part = F.col("n").cast("double") / F.col("total")
    return alone.join(total, group).where((F.col("total") >= least_rows) & (part >= share)).select(group, value, "n", "total", part.alias("share"))


def violations(names: DataFrame, *, target: str | None = None, least_rows: int = SIBLINGS, share: float = SHARE) -> DataFrame:
    """dir, file, stem, casing, expected, suggestion, confidence of files that break their folder's casing.

    With a target casing every file that has another breaks it, at confidence 1. What a file exports can justify its casing.
    """
    voters = names.where(discriminating("stem")).withColumn("casing", casing("stem"))
    if target:
        out = voters.withColumn("expected", F.lit(target)).withColumn("confidence", F.lit(1.0))
    else:
        wins = majority(voters, least_rows=least_rows, share=share).select("dir", F.col("casing").alias("expected"), round_half_up(confidence("share")).alias("confidence"))
        out = voters.join(wins, "dir")
    out = out.where(F.col("casing") != F.col("expected")).where(~F.coalesce(casing_fits_export("casing", "export_kind"), F.lit(False)))
    words = name_words("stem")
    suggestion = F.when(F.col("expected") == "kebab-case", to_casing(words, "kebab-case")).when(F.col("expected") == "snake_case", to_casing(words, "snake_case")).when(F.col("expected") == "PascalCase", to_casing(words, "PascalCase")).otherwise(to_casing(words, "camelCase"))
    return out.withColumn("suggestion", suggestion)


def conforming_share(names: DataFrame, target: str) -> DataFrame:
    """One row: how many voters have the target casing, of how many."""
    voters = names.where(discriminating("stem")).withColumn("casing", casing("stem"))
    return voters.agg(F.count_if(F.col("casing") == target).cast("bigint").alias("conforming"), F.count("*").cast("bigint").alias("total")).withColumn("share", round_half_up(F.coalesce(F.try_divide(F.col("conforming").cast("double"), F.col("total").cast("double")), F.lit(0.0))))


def primary_export_kind(exports: DataFrame) -> DataFrame:
    """(file, export_kind): of default exports, else of those named like the file, else of the first line; several kinds are mixed."""
    ranked = exports.withColumn("rank", F.when(F.col("export_type") == "default", 0).when(F.lower("name") == F.lower("stem"), 1).when(F.col("line") == F.min("line").over(Window.partitionBy("file")), 2).otherwise(3))
    best = ranked.where("rank < 3").withColumn("best", F.min("rank").over(Window.partitionBy("file"))).where("rank = best")
    return best.groupBy("file").agg(F.when(F.countDistinct("kind") == 1, F.min("kind")).otherwise(F.lit("mixed")).alias("export_kind"))
