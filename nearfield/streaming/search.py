"""Streams against a frozen index: queries answered, or objects inserted, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.mutation import first_of_equals
from nearfield.plans.index import Index


def answer_stream(index: Index, queries: DataFrame, k: int, path: str, checkpoint: str, reads: int | None = None) -> StreamingQuery:
    """Writes results of each micro-batch of queries (id, v) under its batch number, so a repeated batch replaces itself."""

    def answer(batch: DataFrame, number: int) -> None:
        index.search(batch, k, reads=reads).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def insert_stream(index: Index, objects: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Projects arriving objects (id, v) with the frozen pivots and appends them to a table partitioned by batch.

    A value that the index holds, or that came in an earlier batch, doesn't enter again; of equal values in one batch the smallest
    id enters. A repeated batch replaces itself.
    """
    spark = index.objects.sparkSession
    names = ["id", "v", "bucket"]

    def held(number: int) -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if number == 0 or not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return index.objects.select("v")
        earlier = spark.read.schema(index.objects.select(*names).schema.add("batch", "integer")).parquet(path).where(F.col("batch") < number)
        return index.objects.select("v").unionByName(earlier.select("v"))

    def add(batch: DataFrame, number: int) -> None:
        fresh = first_of_equals(batch, "v").select("id", "v").join(held(number), "v", "left_anti")
        index._project(fresh.select("id", "v")).select(*names).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return objects.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
