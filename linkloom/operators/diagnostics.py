"""What a change adds to and takes from compiler output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["file", "code", "message"]
LINE = r"^(.*?)\((\d+),(\d+)\): error (TS\d+): (.*)$"
GLOBAL = r"^error (TS\d+): (.*)$"


def parse_compiler_output(outputs: DataFrame) -> DataFrame:
    """side, file, code, message, raw of each error line of (side, output); file is null for errors of no file."""
    lines = outputs.select("side", F.explode(F.split("output", r"\r?\n")).alias("raw")).where(F.col("raw").rlike(LINE) | F.col("raw").rlike(GLOBAL))
    placed = F.col("raw").rlike(LINE)
    return lines.select(
        "side",
        F.when(placed, F.regexp_extract("raw", LINE, 1)).alias("file"),
        F.when(placed, F.regexp_extract("raw", LINE, 4)).otherwise(F.regexp_extract("raw", GLOBAL, 1)).alias("code"),
        F.when(placed, F.regexp_extract("raw", LINE, 5)).otherwise(F.regexp_extract("raw", GLOBAL, 2)).alias("message"),
        "raw",
    )


def incomplete(outputs: DataFrame, parsed: DataFrame) -> DataFrame:
    """(side, incomplete): failed runs with an error of no file, or without a line that can be read."""
    errors = parsed.groupBy("side").agg(F.count("*").alias("n"), F.count_if(F.col("file").isNull()).alias("unplaced"))
    return outputs.join(errors, "side", "left").select("side", (F.col("failed") & ((F.coalesce("n", F.lit(0)) == 0) | (F.coalesce("unplaced", F.lit(0)) > 0))).alias("incomplete"))


def delta(before: DataFrame, after: DataFrame, moved: Column | None = None, key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(new, fixed): by key, whatever the line; all rows of an unseen key are kept. moved: the before-side's paths after the change."""
    if moved is not None:
        before = before.withColumn("file", moved)
    hashed = [F.xxhash64(*key).alias("_h"), *key]

    def without(rows: DataFrame, other: DataFrame) -> DataFrame:
        named = other.select(*hashed).distinct()
        same = rows["_h"] == named["_h"]
        for c in key:
            same = same & rows[c].eqNullSafe(named[c])
        return rows.join(named, same, "left_anti").drop("_h")

    return without(after.withColumn("_h", hashed[0]), before), without(before.withColumn("_h", hashed[0]), after)
