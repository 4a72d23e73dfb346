"""The journal of applied operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .setops import last_by_key

KEPT = 20


def append(journal: DataFrame, entries: DataFrame, kept: int = KEPT) -> DataFrame:
    """The last entries of both."""
    return journal.unionByName(entries, allowMissingColumns=True).orderBy(F.desc("id")).limit(kept)


def retain(events: DataFrame, group: str, order: list[str], kept: int = KEPT) -> DataFrame:
    """The last entries of each group."""
    return last_by_key(events, [group], order, kept)


def to_undo(journal: DataFrame, id: int | None = None) -> DataFrame:
    """The entry of that id, or the last that isn't undone."""
    open_ = journal.where("undone_at is null")
    return open_.where(F.col("id") == id) if id is not None else open_.orderBy(F.desc("id")).limit(1)


def undo_conflicts(entry: DataFrame, contents: DataFrame, root: str = "") -> DataFrame:
    """(path, reason): files that no longer are what the entry left, are gone, or lie outside the repository."""
    expected = entry.select(F.explode("modified").alias("m")).select(F.col("m.path").alias("path"), F.col("m.sha256").alias("expected"))
    now = contents.select("path", F.sha2("content", 256).alias("actual"))
    outside = F.col("path").startswith("../") | F.col("path").contains("/../") | (F.col("path").startswith("/") & ~F.col("path").startswith(root + "/" if root else "\0"))
    reason = F.when(outside, "outside").when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("expected"), "changed")
    return expected.join(now, "path", "left").withColumn("reason", reason).where("reason is not null").select("path", "reason")


def unrelated_changes(entry: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed paths that the entry didn't touch."""
    touched = entry.select(F.explode("modified.path").alias("path")).union(entry.select(F.explode("moved.new").alias("path")))
    return changed.select("path").join(touched, "path", "left_anti")


def mark_undone(journal: DataFrame, entry: DataFrame, at: str) -> DataFrame:
    undone = entry.select("id").withColumn("_now", F.lit(at))
    return journal.join(undone, "id", "left").withColumn("undone_at", F.coalesce("undone_at", "_now")).drop("_now").select(journal.columns)
