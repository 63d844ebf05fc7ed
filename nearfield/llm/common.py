"""Shared helpers: scratch tables in the cluster's shared folder, Arrow batches, label splits."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step works on at once; a longer document is a batch of its own.
SLICE_BYTES = 4_000_000


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only for a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = getattr(scratch_root, "own", None) or tempfile.mkdtemp(prefix="nearfield-")
    scratch_root.own = root
    return f"file://{root}"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, not by rows alone: rows here are whole texts. A session's own stricter setting stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key, None)
        digits = "".join(filter(str.isdigit, now or ""))
        if now is None or not 0 < int(digits or 0) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Tables of one operator call; step() cuts lineage, drop() frees a table no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded_batches(spark)
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made: list[str] = []
        system, path = self._at(self.path)
        system.mkdirs(path)
        system.deleteOnExit(path)  # what a returned table reads stays until the application ends

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def step(self, frame: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{len(self.made):03d}-{name}"
        self.made.append(at)
        frame.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(frame.schema).parquet(at)
        out.scratch_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            if at := getattr(frame, "scratch_path", None):
                system, path = self._at(at)
                system.delete(path, True)

    def keep_only(self, *frames: DataFrame) -> None:
        """Frees all tables but these."""
        kept = {frame.scratch_path for frame in frames}
        for at in self.made:
            if at not in kept:
                system, path = self._at(at)
                system.delete(path, True)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of steps that are over, which it does when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed_rows(documents: DataFrame, *more: Column) -> DataFrame:
    """text, row (a struct of all other columns), and more: no name inside an operator can clash with a column of the table."""
    others = [F.col(quoted(c)) for c in documents.columns if c != "text"]
    return documents.select("text", F.struct(*others).alias("row"), *more)


def unpacked_rows(packed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that packed_rows put together."""
    return packed.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hashed_share(columns: list[Column], share: float) -> Column:
    """A repeatable choice of about that share of rows; never used to decide what is scored."""
    return F.pmod(F.xxhash64(*columns, F.lit("training sample")), F.lit(1_000_000)) < int(share * 1_000_000)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds at most limit bytes of text, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def forget_tokenizers() -> None:
    """Frees the caches that a tokenizing step left in this Python worker; workers serve one step after another."""
    if kept := sys.modules.get("nearfield.llm.chunks"):
        kept._made.clear()
    give_back()


def give_back() -> None:
    """Returns to the system what is free inside this Python worker; the allocators would keep the most that any step took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null counts as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def gather(starts: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Concatenates pool[starts[i] : starts[i] + lengths[i]] for all i."""
    total = int(lengths.sum())
    if not total:
        return pool[:0]
    before = np.cumsum(lengths) - lengths
    return pool[np.repeat(starts - before, lengths) + np.arange(total)]
