"""Views and indexes that follow a journal of changes, and windows over events.

The journal is a folder of Parquet files with rows (seq, op, doc_id, name, key, value): op is insert, update or delete of the
element ``name`` with the key. A view keeps, per group, what ``model`` makes of the live elements; each micro-batch recomputes the
groups it touches and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JOURNAL = "seq long, op string, doc_id long, name string, key string, group string, value double"


def live(journal: DataFrame) -> DataFrame:
    """The elements that are left, each as its last change has it."""
    last = Window.partitionBy("doc_id", "name", "key").orderBy(F.desc("seq"))
    return journal.withColumn("_n", F.row_number().over(last)).where("_n = 1 and op <> 'delete'").drop("_n")


def view(journal: DataFrame, name: str, **aggregates: Column) -> DataFrame:
    """The view over a whole journal: one row per group that has elements."""
    return live(journal).where(F.col("name") == name).groupBy("group").agg(*[c.alias(n) for n, c in aggregates.items()])


def maintain(spark: SparkSession, journal: str, into: str, checkpoint: str, name: str, aggregates: Callable[[], dict], buckets: int = 16):
    """A streaming query that keeps ``view`` in the folder ``into``, in buckets of groups; a batch rewrites the buckets it touches.

    The elements themselves are kept beside the view, so a batch reads its buckets' elements and not the journal. A batch that is
    run again after a failure gives the same result, since changes carry their sequence number.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "name", "key"), F.lit(buckets)).cast("int")
    schema = spark.createDataFrame([], JOURNAL).schema

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        mine = batch.where(F.col("name") == name).withColumn("bucket", bucket).persist()
        touched = [r[0] for r in mine.select("bucket").distinct().collect()]
        if touched:
            try:
                old = session.read.parquet(f"{into}/elements").where(F.col("bucket").isin(touched)).select(*mine.columns)
                both = old.unionByName(mine)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
                both = mine
            last = Window.partitionBy("doc_id", "name", "key").orderBy(F.desc("seq"))
            kept = both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
            kept.write.mode("overwrite").parquet(f"{into}/next")
            session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            session.read.schema(kept.schema).parquet(f"{into}/next").write.mode("overwrite").partitionBy("bucket").parquet(f"{into}/elements")
            alive = session.read.parquet(f"{into}/elements").where("op <> 'delete'")
            alive.groupBy("group").agg(*[c.alias(n) for n, c in aggregates().items()]).write.mode("overwrite").parquet(f"{into}/view")
        mine.unpersist()

    stream = spark.readStream.schema(schema).parquet(journal)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts per window of event time; works on tables and on streams. (An addition: trees have no windows of time.)"""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
