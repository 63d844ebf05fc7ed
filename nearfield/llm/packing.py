"""Sum-of-squares online packing into windows of a fixed number of tokens.

N(h) is the number of open windows filled to level h. Each remainder of a document goes to the level h (or a new window, h = 0)
that makes the sum of N(h)^2 smallest afterwards; full and empty windows don't count. Whole windows of a long document need no
choice. Every input partition packs on its own, in row order; prefix sums over the partitions number the windows. When a
partition ends, its open windows fill one another: pieces are cut from the emptiest to close the fullest, so at most one window of
a partition isn't full. The same happens whenever MOST_OPEN windows are open, which bounds a task's memory at any sizes of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.chunks import encoder
from nearfield.llm.common import Scratch, give_back, slices

PIECES = "part int, local long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long"
ROWS = 20_000
#: Open windows of one task.
MOST_OPEN = 4096


class SumOfSquares:
    """Open windows by level, and the choice of a level for the next size."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(capacity + 1)]  # the level array; a window is a list of pieces

    def choose(self, size: int) -> int:
        """The level, 0 for a new window, that a piece of this size goes to; of equal choices the fullest."""
        n = self.counts
        new = 0 if size == self.capacity else 2 * int(n[size]) + 1
        open_ = np.flatnonzero(n[1 : self.capacity - size + 1]) + 1
        if not len(open_):
            return 0
        after = open_ + size
        change = 1 - 2 * n[open_] + np.where(after < self.capacity, 2 * n[after] + 1, 0)
        best = len(open_) - 1 - int(np.argmin(change[::-1]))
        return int(open_[best]) if change[best] <= new else 0

    def place(self, size: int, piece) -> list | None:
        """The window if this closes it."""
        level = self.choose(size)
        window = self.levels[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.counts[level + size] += 1
        self.levels[level + size].append(window)
        return None

    @property
    def open(self) -> int:
        return int(self.counts.sum())

    def drain(self) -> list[list]:
        """Closes the fullest open windows with pieces cut from the emptiest; at most one window stays open.

        Pieces are (document, start, ids, tokens).
        """
        rest = [(level, w) for level in range(1, self.capacity) for w in self.levels[level]]
        self.counts[:] = 0
        self.levels = [[] for _ in range(self.capacity + 1)]
        low, closed = 0, []
        while low < len(rest):
            level, window = rest.pop()
            need = self.capacity - level
            while need and low < len(rest):
                left, donor = rest[low]
                doc, start, ids, total = donor.pop()
                take = min(need, len(ids))
                if take < len(ids):
                    donor.append((doc, start, ids[:-take], total))
                    start, ids = start + len(ids) - take, ids[-take:]
                window.append((doc, start, ids, total))
                need -= take
                rest[low] = (left - take, donor)
                low += not donor
            if need:
                self.counts[self.capacity - need] = 1
                self.levels[self.capacity - need].append(window)
            else:
                closed.append(window)
        return closed


def pack(documents: DataFrame, capacity: int = 1024, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, name: str = "packing", most_open: int = MOST_OPEN) -> DataFrame:
    """Pieces of documents in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and end_id; a null text is the empty one and packs as end_id alone. A null doc_id
    stays null; rows that share a doc_id pack each; of equal choices the fullest level is taken; a text of any length is cut into
    windows as it is encoded whole; an empty table gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    store = Scratch(spark, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, packer = encoder(vocabulary), TaskContext.get().partitionId(), SumOfSquares(capacity)
        rows: list[tuple] = []
        local = 0

        def close(window: list) -> None:
            nonlocal local
            at = 0
            for doc, start, ids, total in window:
                rows.append((part, local, doc, start, len(ids), zlib.crc32(ids.tobytes()), total, at))
                at += len(ids)
            local += 1

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({f.name: pa.array(c, f.type) for f, c in zip(schema, zip(*rows, strict=True), strict=True)}, schema=schema)
            rows.clear()
            return made

        give_back()
        schema = pa.schema([("part", pa.int32())] + [(n, pa.int64()) for n in ("local", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")])
        for batch in batches:
            for piece in slices(batch, limit=2_000_000):
                ids, sizes = tool.encode(piece.column("text"))
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
                end = 0
                for doc, n in zip(piece.column("doc_id").to_pylist(), (sizes + 1).tolist(), strict=True):
                    own, end = ids[end : end + n], end + n
                    cut = n - n % capacity
                    for start in range(0, cut, capacity):
                        close([(doc, start, own[start : start + capacity], n)])
                    if cut < n and (window := packer.place(n - cut, (doc, cut, own[cut:].copy(), n))):
                        close(window)
                    if packer.open >= most_open:
                        for window in packer.drain():
                            close(window)
                    if len(rows) >= ROWS:
                        yield out()
                del ids, own
            give_back()
        for window in [*packer.drain(), *(w for level in packer.levels for w in level)]:
            close(window)
            if len(rows) >= ROWS:
                yield out()
        if rows:
            yield out()
        del packer
        give_back()

    pieces = store.step(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES), "pieces")
    # One number for each partition of the input.
    counts = sorted(tuple(r) for r in pieces.groupBy("part").agg((F.max("local") + 1).alias("n")).collect())
    firsts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, firsts, strict=False)], "part int, base long")
    return pieces.join(bases, "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"), "offset")
