"""What a change to a file reaches, and what its move would need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import package_of_strict
from .graph import all_references


def risk_band(n: Column, boundary: Column, missing: Column, instability: Column) -> Column:
    """Instability is 1 where it is unknown."""
    unstable = F.coalesce(instability, F.lit(1.0))
    high = (missing > 0) | (n >= 20) | (boundary & (n >= 5))
    medium = boundary | (n >= 5) | ((n > 0) & (unstable <= 0.3))
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def impact(refs: DataFrame, barrel_entries: DataFrame, targets: DataFrame, packages: DataFrame, metrics: DataFrame, missing: DataFrame) -> DataFrame:
    """A row for each target: importers (through barrels), whether they cross a package, missing dependencies, risk.

    packages: (file, package); missing: (node, n_missing).
    """
    uses = all_references(refs, barrel_entries, targets).where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("importer")).distinct()
    home, away = packages.select(F.col("file").alias("node"), F.col("package").alias("home")), packages.select(F.col("file").alias("importer"), F.col("package").alias("away"))
    crossed = uses.join(home, "node", "left").join(away, "importer", "left")
    counted = crossed.groupBy("node").agg(F.count("*").cast("bigint").alias("importers"), F.bool_or(~F.col("home").eqNullSafe(F.col("away"))).alias("boundary"))
    out = targets.select("node").distinct().join(counted, "node", "left").fillna(0, ["importers"]).fillna(False, ["boundary"])
    out = out.join(metrics.select("node", "instability"), "node", "left").join(missing.select("node", "n_missing"), "node", "left").fillna(0, ["n_missing"])
    return out.withColumn("risk", risk_band(F.col("importers"), F.col("boundary"), F.col("n_missing"), F.col("instability")))


def missing_dependencies(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """(node, package): packages that a file imports and the target's manifest doesn't name."""
    used = imports.select("node", package_of_strict("specifier").alias("package")).where("package is not null").distinct()
    return used.join(declared.where("section in ('dependencies', 'peerDependencies')").select("node", F.col("name").alias("package")), ["node", "package"], "left_anti")


def dependency_additions(needed: DataFrame, source: DataFrame, target: DataFrame, internal: DataFrame | None = None) -> DataFrame:
    """(package, section, specifier) to add: as the source manifest has it, dependencies before peers, never over an entry.

    Packages of the workspace itself are asked for as workspace:*.
    """
    order = F.when(F.col("section") == "dependencies", 0).otherwise(1)
    have = source.where("section in ('dependencies', 'peerDependencies')").groupBy("name").agg(F.min(F.struct(order.alias("o"), "section", "specifier")).alias("s"))
    out = needed.select("package").distinct().join(target.select(F.col("name").alias("package")), "package", "left_anti")
    out = out.join(have.select(F.col("name").alias("package"), F.col("s.section").alias("section"), F.col("s.specifier").alias("specifier")), "package", "left")
    if internal is not None:
        out = out.join(internal.select(F.col("name").alias("package"), F.lit(True).alias("own")), "package", "left")
        out = out.select("package", F.when(F.col("own"), "dependencies").otherwise(F.col("section")).alias("section"), F.when(F.col("own"), "workspace:*").otherwise(F.col("specifier")).alias("specifier"))
    return out.where("specifier is not null")


def restricted(additions: DataFrame, forbidden: DataFrame) -> DataFrame:
    return additions.join(forbidden.select(F.col("name").alias("package")), "package", "left_semi")
