"""Keyed tables: point reads, inclusive ranges both ways, first value of each key, upsert, delete; and result sinks."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def settled(frame: DataFrame, name: str) -> DataFrame:
    """The rows of frame, written once to the folder of spark.checkpoint.dir and read again; they stay until the application ends.

    A local master without that setting uses a folder of its own.
    """
    spark = frame.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = settled.own = getattr(settled, "own", None) or f"file://{tempfile.mkdtemp(prefix='nearfield-')}"
    at = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    frame.write.parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(frame.schema).parquet(at)


class KeyedTable:
    """A table by a key column, of unique keys or with duplicates. Methods return new tables; nothing is changed in place."""

    def __init__(self, rows: DataFrame, key: str, value: str, duplicates: bool = False):
        self.rows, self.key, self.value, self.duplicates = rows, key, value, duplicates

    def get(self, key) -> DataFrame:
        if self.duplicates:
            raise ValueError("a table with duplicate keys has no single value; use get_all")
        return self.get_all(key)

    def get_all(self, key) -> DataFrame:
        return self.rows.where(F.col(self.key) == F.lit(key))

    def put(self, new: DataFrame) -> KeyedTable:
        kept = self.rows if self.duplicates else self.rows.join(new.select(self.key), self.key, "left_anti")
        return KeyedTable(kept.unionByName(new), self.key, self.value, self.duplicates)

    def delete(self, keys: DataFrame) -> KeyedTable:
        return KeyedTable(self.rows.join(keys.select(self.key), self.key, "left_anti"), self.key, self.value, self.duplicates)

    def clear(self) -> KeyedTable:
        return KeyedTable(self.rows.limit(0), self.key, self.value, self.duplicates)

    def size(self) -> int:
        return self.rows.count()

    def next_id(self) -> int:
        found = self.rows.agg(F.max(self.key)).first()[0]
        return 0 if found is None else found + 1

    def range(self, low, high, reverse: bool = False) -> DataFrame:
        """Both ends are included; the condition reaches the file scan."""
        order = [F.col(self.key).desc(), F.col(self.value).desc()] if reverse else [F.col(self.key), F.col(self.value)]
        return self.rows.where(F.col(self.key).between(low, high)).orderBy(*order)

    def range_no_duplicates(self, low, high, reverse: bool = False) -> DataFrame:
        """The smallest value of each key in the range."""
        first = Window.partitionBy(self.key).orderBy(self.value)
        found = self.rows.where(F.col(self.key).between(low, high)).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        return found.orderBy(F.col(self.key).desc() if reverse else F.col(self.key))

    def multimap(self) -> DataFrame:
        return self.rows.groupBy(self.key).agg(F.sort_array(F.collect_list(self.value)).alias("values"))

    def save(self, path: str, sort: bool = True) -> None:
        out = self.rows.repartitionByRange(F.col(self.key)).sortWithinPartitions(self.key) if sort else self.rows
        out.write.mode("overwrite").parquet(path)


#: The columns of the experiment report.
REPORT = ["exp_name", "details", "dist", "smap", "ep", "recall", "zeros", "buckets"]


def append_report(rows: DataFrame, path: str) -> None:
    rows.select(*REPORT).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def write_cost_histogram(costs: DataFrame, path: str) -> None:
    """(nearest distance, distance computations) for each query."""
    costs.select("nearest", "computations").write.mode("overwrite").option("header", True).csv(path)


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))  # one line that save_json wrote
