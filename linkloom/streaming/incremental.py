"""Fact tables kept up to date from a stream of changed files.

Each micro-batch replaces the facts of the files that it holds. Facts are stored in buckets of file names, and a batch
rewrites only the buckets it touches. Buckets that lose their last row are removed after the others are written, so the
change of a batch isn't one commit; a batch that is run again after a failure leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import replace_rows
from ..operators.setops import first_by_key

BUCKETS = 64


def bucket(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(spark: SparkSession, path: str, fresh: DataFrame, changed: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """All rows of changed keys give way to the fresh ones; only their buckets are read and written."""
    fresh = fresh.withColumn("bucket", bucket(key, buckets))
    touched = [r["bucket"] for r in changed.select(bucket(key, buckets).alias("bucket")).distinct().collect()]  # at most BUCKETS
    try:
        stored = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = None
    new = fresh if stored is None else replace_rows(stored.select(fresh.columns), fresh, changed, key)
    # written aside first: a table can't be read and overwritten in one plan
    aside = f"{path}.next"
    new.write.mode("overwrite").partitionBy("bucket").parquet(aside)
    done = spark.read.schema(new.schema).parquet(aside)
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    left = {r["bucket"] for r in done.select("bucket").distinct().collect()}
    for b in touched:
        if b not in left:
            delete(spark, f"{path}/bucket={b}")
    delete(spark, aside)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def latest_texts(batch: DataFrame) -> DataFrame:
    """The newest row of each path in a batch."""
    return first_by_key(batch, ["path"], [F.desc("mtime")])


def keep_facts(texts: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "src") -> StreamingQuery:
    """Starts a query that keeps the table at a path; texts: a stream of path, content, mtime; extract: facts of texts, by key."""

    def each(batch: DataFrame, _: int) -> None:
        now = latest_texts(batch)
        upsert(batch.sparkSession, path, extract(now), now.select(F.col("path").alias(key)), key)

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n per tumbling window, with a watermark; on a static table the same rows."""
    counted = events.withWatermark("ts", late) if events.isStreaming else events
    return counted.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").cast("bigint").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
