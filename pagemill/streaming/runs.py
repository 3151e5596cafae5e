"""Run a streaming plan over what has arrived and hand back the result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagemill.session import work_folder


def file_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Stream of the Parquet files of one table in a folder of tables."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    )


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input into a table (append mode)."""
    spark = stream.sparkSession
    out, state = work_folder(spark, name), work_folder(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drained_updates(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Process all available input in update mode; the last update per key counts."""
    spark = stream.sparkSession
    out, state = work_folder(spark, name), work_folder(spark, f"{name}-state")

    def keep(batch: DataFrame, number: int) -> None:
        # Rewriting the batch's own folder makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    updates = spark.read.parquet(out)
    newest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return (
        updates.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n", "batch")
        .select(*stream.columns)
    )
