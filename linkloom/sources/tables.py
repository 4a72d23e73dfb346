"""Tables of facts and of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_sources(spark: SparkSession, folder: str, pattern: str = "*.{ts,tsx,js,jsx,mts,cts,mjs,cjs,vue}") -> DataFrame:
    """path, content, mtime of source files, read in parallel; paths are relative to the folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    plain = F.regexp_replace("path", r"^file:/*", "/")
    head = folder.removeprefix("file://").rstrip("/") + "/"
    path = F.when(plain.startswith(head), F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(head) + 1})")).otherwise(plain)
    rows = rows.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"))
    return rows.where(~F.col("path").rlike(r"(^|/)(node_modules|\.git)/"))


def export_index(fresh: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Export facts by (file, mtime): stored rows of files that haven't changed, fresh ones of the rest."""
    if stored is None:
        return fresh
    unchanged = stored.join(fresh.select("file", "mtime").distinct(), ["file", "mtime"], "left_semi")
    return unchanged.unionByName(fresh.join(stored.select("file", "mtime").distinct(), ["file", "mtime"], "left_anti"))


def script_blocks(pages: DataFrame, text: str = "html") -> DataFrame:
    """Rows with the chosen script of a page: ``script``, ``lang`` and ``script_at``; one marked setup first, else the first.

    A script is ts unless it says js; script_at is where its content begins, in UTF-16 units.
    """
    block = r"(?is)(<script(\s[^>]*)?\s*>)(.*?)</script>"
    whole, opening, heads, bodies = (F.regexp_extract_all(text, F.lit(block), F.lit(k)) for k in range(4))
    between = F.split(text, block, -1)
    units = lambda x: F.octet_length(F.encode(x, "UTF-16LE")) / 2
    size = lambda items, n: F.aggregate(F.slice(items, F.lit(1), n), F.lit(0.0), lambda s, x: s + units(x))
    places = F.transform(whole, lambda x, k: size(between, k + 1) + size(whole, k) + units(F.get(opening, k)))
    blocks = F.arrays_zip(heads.alias("head"), bodies.alias("body"), places.alias("at"))
    setup = F.filter(blocks, lambda b: b["head"].rlike(r"(?i)\bsetup\b"))
    chosen = F.coalesce(F.try_element_at(setup, F.lit(1)), F.try_element_at(blocks, F.lit(1)))
    lang = F.when(chosen.isNotNull(), F.when(F.coalesce(chosen["head"], F.lit("")).rlike(r"""(?i)\blang=["']?js"""), "js").otherwise("ts"))
    return pages.withColumn("script", chosen["body"]).withColumn("lang", lang).withColumn("script_at", chosen["at"].cast("int"))


def git_ignored(paths: DataFrame, ignored: DataFrame | None) -> DataFrame:
    """paths with ``ignored``; where git couldn't be asked (None) nothing is ignored."""
    if ignored is None:
        return paths.withColumn("ignored", F.lit(False))
    marks = ignored.select("path").distinct().withColumn("ignored", F.lit(True))
    return paths.join(marks, "path", "left").fillna(False, ["ignored"])
