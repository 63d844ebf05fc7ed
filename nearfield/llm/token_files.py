"""Token-id files: flat unsigned integers plus 64-bit document offsets, one pair of files for each range of documents.

Documents are dealt into ranges of ascending id and sorted inside each range. A task encodes its range and writes

* ``<range>.ids``: the ids of its documents on end, as little-endian unsigned integers of 2 bytes (vocabulary up to 65,536) or 4;
* ``<range>.off``: little-endian signed 64-bit: number of documents, number of null document ids (these come first), then the
  document ids, then ``documents + 1`` offsets into the range's ids;

under a name of its own attempt, then renames it, so a lost executor's range is simply written again. The driver keeps one small
record for each range; a prefix sum over them gives every range the global start of its ids. Readers map the files into memory.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.chunks import encoder
from nearfield.llm.common import bounded_batches, slices

WRITTEN = "part int, documents long, tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass(frozen=True)
class TokenFiles:
    """A written set: its folder, bytes of an id, and (range, documents, tokens, global start) of each range."""

    folder: str
    width: int
    parts: tuple[tuple[int, int, int, int], ...]

    def manifest(self) -> str:
        return json.dumps({"width": self.width, "parts": self.parts})


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder as Spark names it: object stores go by other scheme names there."""
    scheme, _, rest = folder.partition(":")
    if scheme == "dbfs":
        folder = "file:///dbfs/" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        folder = "s3:" + rest
    return fs.FileSystem.from_uri(folder)


def _write(store: fs.FileSystem, path: str, name: str, chunks: list[bytes]) -> None:
    own = f"{path}/.{name}-{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(own, f"{path}/{name}")


def write_token_files(documents: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end_id: int | None = 1, parts: int | None = None, largest_id: int = 49_407) -> TokenFiles:
    """Writes the ids of every whole text in ascending doc_id order; end_id is appended to each document.

    A null text is the empty one; a null doc_id sorts first; rows that share a doc_id are ordered by a checksum of their text, then by
    text, so that many of them spread over ranges. A text of any length is encoded whole. An empty table gives no ranges. Other
    columns are ignored. folder is a URI that Spark and pyarrow's file systems both know (file, hdfs, s3a, gs, abfss, dbfs).
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    width = 2 if max(largest_id, end_id or 0) < 1 << 16 else 4
    parts = parts or max(documents.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    store, path = opened(folder)
    store.create_dir(path, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(vocabulary), TaskContext.get().partitionId()
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        ids, keys, counts, nulls = None, [], [np.zeros(1, np.int64)], 0
        own = f"{path}/.{part:06d}.ids-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            for piece in slices(batch):
                found, sizes = tool.encode(piece.column("text"))
                if end_id is not None:
                    found, sizes = np.insert(found, np.cumsum(sizes), end_id), sizes + 1
                ids = ids or store.open_output_stream(own)
                ids.write(found.astype(f"<u{width}").tobytes())
                key = piece.column("doc_id")
                nulls += key.null_count
                keys.append(np.asarray(key.fill_null(0)).astype("<i8"))
                counts.append(sizes)
        if ids is None:
            return
        ids.close()
        store.move(own, f"{path}/{part:06d}.ids")
        keys, ends = np.concatenate(keys), np.cumsum(np.concatenate(counts)).astype("<i8")
        _write(store, path, f"{part:06d}.off", [np.array([len(keys), nulls], "<i8").tobytes(), keys.tobytes(), ends.tobytes()])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "documents": [len(keys)], "tokens": [int(ends[-1])]})

    dealt = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("spread", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "spread")
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "spread", "text").drop("spread")
    # One record for each range, not for each document.
    written = sorted(tuple(r) for r in ordered.mapInArrow(encode, WRITTEN).collect())
    starts = np.cumsum([0, *(r[2] for r in written)]).tolist()
    made = TokenFiles(folder, width, tuple((*r, s) for r, s in zip(written, starts, strict=False)))
    with store.open_output_stream(f"{path}/manifest.json") as out:
        out.write(made.manifest().encode())
    return made


def open_part(files: TokenFiles, part: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Document ids, how many of them are null, offsets, and ids of one range, mapped into memory where the store allows it."""
    store, path = opened(files.folder)
    local = isinstance(store, fs.LocalFileSystem)

    def load(name: str, kind: str) -> np.ndarray:
        if not local:
            with store.open_input_file(f"{path}/{name}") as f:
                return np.frombuffer(f.read(), kind)
        return np.memmap(f"{path}/{name}", kind, "r")

    head = load(f"{part:06d}.off", "<i8")
    n = int(head[0])
    ids = load(f"{part:06d}.ids", f"<u{files.width}") if int(head[-1]) else np.zeros(0, f"<u{files.width}")
    return head[2 : 2 + n], int(head[1]), head[2 + n :], ids


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row for each document: where its ids start among all ids, how many there are, and their checksum."""
    starts = {p[0]: p[3] for p in files.parts}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                keys, nulls, offsets, ids = open_part(files, part)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(keys, pa.int64(), mask=np.arange(len(keys)) < nulls),
                    "start": pa.array(starts[part] + offsets[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })

    listed = spark.createDataFrame([(p[0],) for p in files.parts], "part int")
    return listed.repartition(max(1, len(files.parts))).mapInArrow(read, READ)
