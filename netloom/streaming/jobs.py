"""Structured Streaming forms of the histories and of the upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream: (element, at, ts, state, value, event_id)."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return rows.select(F.col("user_id").alias("element"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("state"), "value", "event_id")


def hourly(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Means of the clock hours; rows later than ``late`` are left out once their hour is closed."""
    hour = F.window("ts", "1 hour")
    return rows.where("value is not null").withWatermark("ts", late).groupBy("element", hour).agg(F.avg("value").alias("avg"), F.count("value").alias("cnt")).select("element", F.col("window.start").alias("bucket"), "avg", "cnt")


def hourly_late(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """(element, bucket, sum, cnt) of samples that may come out of order and more
    than once, each hour when it is closed. Sums and counts add up, so a late
    sample counts in its own hour; repeated ones (by event_id) count once."""
    once = rows.where("value is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("element", F.window("ts", "1 hour")).agg(F.sum("value").alias("sum"), F.count("value").alias("cnt")).select("element", F.col("window.start").alias("bucket"), "sum", "cnt")


def run(rows: DataFrame, folder: str, mode: str, key: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream to the end of its input; each batch is written under its
    number, so a repeated batch replaces itself. Returns the rows of all
    batches; in update mode the last of each ``key``."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    q = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out").drop("n")
    if mode == "update":
        values = [c for c in out.columns if c not in (*key, "batch")]
        out = out.groupBy(*key).agg(*(F.max_by(c, "batch").alias(c) for c in values))
    return out.drop("batch")


def upserted(rows: DataFrame, folder: str) -> DataFrame:
    """(id, state, seen): the latest state of each element and how often it was
    seen, merged batch by batch into a new version of the table. Versions are
    named by their batch, so a repeated batch writes the same one again."""
    spark = rows.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        last = F.row_number().over(Window.partitionBy("element").orderBy(F.desc("at"), F.desc("event_id")))
        seen = F.count("*").over(Window.partitionBy("element"))
        new = batch.withColumns({"_n": last, "seen": seen}).where("_n = 1").select(F.col("element").cast("string").alias("id"), "state", "seen", F.struct("at", "event_id").alias("at"))
        if number:
            old = spark.read.parquet(f"{folder}/v={number - 1}")
            both = old.union(new.select(*old.columns))
            new = both.groupBy("id").agg(F.max_by("state", "at").alias("state"), F.sum("seen").alias("seen"), F.max("at").alias("at"))
        new.write.mode("overwrite").parquet(f"{folder}/v={number}")

    q = rows.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/v={q.lastProgress['batchId']}").select("id", "state", "seen")
