"""Finding files and exports by name or path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, matches_path, stem

#: Not searched for exports.
UNSEARCHED = (".vue",)


def find_names(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose name holds the query in any case, with ``exact``; exact ones first, then in locale order."""
    low = F.lower(column)
    return rows.where(F.contains(low, F.lit(query.lower()))).withColumn("exact", low == query.lower()).orderBy(F.desc("exact"), F.collate(column, "UNICODE"), column)


def find(files: DataFrame, exports: DataFrame, query: str, kind: str = "all") -> DataFrame:
    """kind, file, name, exact: files by file name or stem, exports by name."""
    low = query.lower()
    by_file = files.select("file").where(F.contains(F.lower(basename("file")), F.lit(low)) | (F.lower(stem("file")) == low))
    by_file = by_file.select(F.lit("file").alias("kind"), "file", basename("file").alias("name"), (F.lower(stem("file")) == low).alias("exact"))
    searched = exports
    for end in UNSEARCHED:
        searched = searched.where(~F.col("file").endswith(end))
    by_name = searched.where(F.contains(F.lower("name"), F.lit(low))).select(F.lit("export").alias("kind"), "file", "name", (F.lower("name") == low).alias("exact"))
    out = {"file": by_file, "export": by_name}.get(kind)
    out = by_file.unionByName(by_name) if out is None else out
    return out.orderBy(F.desc("exact"), F.collate(F.when(F.col("kind") == "file", F.col("file")).otherwise(F.col("name")), "UNICODE"), "file")


def related(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    return rows.where(matches_path(column, pattern))
