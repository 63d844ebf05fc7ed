"""Benchmark decontamination by greedy string tiling.

Every benchmark item and every document is a sequence of words. Windows of min_match words, hashed as Karp-Rabin does, are the
seeds; a document is compared only with items it shares seeds with. Runs of seeds on one diagonal are the maximal common
passages. The longest is marked first, later ones only where words are unmarked on both sides, until none of min_match words is
left. An item whose marked share reaches the threshold is in the document, in whatever order its passages stand.

The benchmark is the query side: it is cut into blocks of bounded size, and each block meets all documents in one pass without a
shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, forget_tokenizers, packed_rows, slices, unpacked_rows
from nearfield.llm.words import hashed_words, window_hashes

FOUND = "row_key long, item_id long, coverage double, item_words int, tiles array<struct<item_at:int,doc_at:int,words:int>>"
#: Words of one block of the benchmark.
BLOCK_WORDS = 400_000
FILTER_BITS = 20


#: Seeds of one text and item that are expanded at once; a place of the text with more is a part of its own.
SEEDS = 500_000


def _joined(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (place in item, place in text, seeds) of one diagonal that follow each other become one."""
    rank = np.lexsort((i, j - i))
    i, j, n = i[rank], j[rank], n[rank]
    starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + n[:-1]) | (np.diff(j - i) != 0)]) if len(i) else rank
    return i[starts], j[starts], np.add.reduceat(n, starts) if len(i) else n


def tiling(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, words), longest first, ties by place."""
    min_match = min(min_match, len(item))
    if not min_match:
        return []
    own, other = window_hashes(item, min_match), window_hashes(text, min_match)
    order = np.argsort(own, kind="stable")
    there = np.flatnonzero(np.isin(other, own))
    low, high = np.searchsorted(own[order], other[there]), np.searchsorted(own[order], other[there], side="right")
    met = np.cumsum(high - low)
    if not len(met):
        return []
    # Seeds are expanded and joined to runs part by part, so that repetitive texts stay bounded; runs that meet are joined again.
    cuts = [0, *np.searchsorted(met, np.arange(SEEDS, int(met[-1]), SEEDS)).tolist(), len(there)]
    runs = []
    for begin, end in zip(cuts, cuts[1:], strict=False):
        span = (high - low)[begin:end]
        j = np.repeat(there[begin:end], span)
        i = order[np.repeat(low[begin:end] - (np.cumsum(span) - span), span) + np.arange(span.sum())]
        runs.append(_joined(i, j, np.ones(len(i), np.int64)))
    i, j, n = _joined(*(np.concatenate(c) for c in zip(*runs, strict=True)))
    starts, sizes = np.arange(len(i)), n + min_match - 1
    heap = [(-n, a, b) for n, a, b in zip(sizes.tolist(), i[starts].tolist(), j[starts].tolist(), strict=True)]
    heapq.heapify(heap)
    used_i, used_j, tiles = np.zeros(len(item), bool), np.zeros(len(text), bool), []
    while heap and not used_i.all():
        n, a, b = heapq.heappop(heap)
        n = -n
        free = ~(used_i[a : a + n] | used_j[b : b + n])
        if free.all():
            used_i[a : a + n] = used_j[b : b + n] = True
            tiles.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False]))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= min_match:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return tiles


class Block:
    """Items with their seeds in sorted order, and a bit filter over them."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.ids = [i for i, _ in items]
        words, counts = hashed_words(pa.array([t for _, t in items], pa.string()), spoken=True)
        ends = np.cumsum(counts)
        self.words = [words[e - n : e] for e, n in zip(ends, counts, strict=True)]
        self.seeds = {}
        for size in sorted({min(min_match, len(w)) for w in self.words if len(w)}):
            own = [(window_hashes(w, size), k) for k, w in enumerate(self.words) if min(min_match, len(w)) == size]
            keys = np.concatenate([h for h, _ in own])
            item = np.concatenate([np.full(len(h), k) for h, k in own])
            place = np.concatenate([np.arange(len(h)) for h, _ in own])
            order = np.argsort(keys, kind="stable")
            near = np.zeros(1 << FILTER_BITS, bool)
            near[keys >> np.uint64(64 - FILTER_BITS)] = True
            self.seeds[size] = (near, keys[order], item[order], place[order])

    def hits(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, places in the item of shared seeds) over a batch of texts on end."""
        ends = np.cumsum(counts)
        for size, (near, keys, item, place) in self.seeds.items():
            hashes = window_hashes(words, size)
            at = np.flatnonzero(near[hashes >> np.uint64(64 - FILTER_BITS)])
            at = at[keys[np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)] == hashes[at]]
            text = np.searchsorted(ends, at, side="right")
            inside = at + size <= ends[text]
            at, text = at[inside], text[inside]
            if not len(at):
                continue
            # A text's repeated seed counts once here; tiling() looks at every place.
            pairs = np.unique(np.stack([text.astype(np.uint64), hashes[at]], 1), axis=0)
            text, seed = pairs[:, 0].astype(np.int64), pairs[:, 1]
            low, high = np.searchsorted(keys, seed), np.searchsorted(keys, seed, side="right")
            met = np.cumsum(high - low)
            # Texts are handled in groups, so that seeds of many items stay bounded.
            ahead = np.flatnonzero(np.r_[True, np.diff(text) != 0])
            begin = 0
            while begin < len(text):
                done = int(met[begin - 1]) if begin else 0
                later = ahead[(ahead > begin) & (met[ahead - 1] - done >= SEEDS)]
                end = int(later[0]) if len(later) else len(text)
                span = (high - low)[begin:end]
                slot = np.repeat(low[begin:end] - (np.cumsum(span) - span), span) + np.arange(span.sum())
                rows = np.stack([np.repeat(text[begin:end], span), item[slot], place[slot]], 1)
                rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
                cut = np.flatnonzero(np.r_[True, (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)])
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True):
                    yield int(rows[a, 0]), int(rows[a, 1]), rows[a:b, 2]
                begin = end

    def covered(self, column: pa.Array, min_match: int, threshold: float) -> Iterator[tuple[int, int, float, list]]:
        """(text, item, share, tiles) wherever tiles cover at least the threshold of an item."""
        words, counts = hashed_words(column, spoken=True)
        ends = np.cumsum(counts)
        for text, k, places in self.hits(words, counts):
            item = self.words[k]
            size = min(min_match, len(item))
            reach = np.zeros(len(item) + 1, np.int64)
            np.add.at(reach, places, 1)
            np.add.at(reach, places + size, -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < threshold * len(item):
                continue  # tiles lie within shared seeds
            tiles = tiling(item, words[ends[text] - counts[text] : ends[text]], min_match)
            share = sum(n for _, _, n in tiles) / len(item)
            if share >= threshold:
                yield text, k, share, tiles


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, words = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").toLocalIterator():
        block.append((item, text))
        words += len(text) // 2 + 1
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def benchmark_passages(documents: DataFrame, benchmark: DataFrame, min_match: int = 4, threshold: float = 0.5, key: str = "doc_id") -> DataFrame:
    """Pairs (key, item_id) where tiles of min_match words or more cover at least the threshold of the item.

    Columns: doc_id (named by key), item_id, coverage, item_words, tiles. Null or empty texts and items, and null item ids, pair
    with nothing; items shorter than min_match match as a whole; rows that share a key pair each; of equally long tiles the first
    place in the item, then in the document, is marked first; a text of any length is compared whole, with its seeds expanded part by
    part; empty tables give no rows; other columns are ignored.
    """
    rows = documents.select(F.col(key).cast("long").alias("row_key"), "text").where("text is not null")

    def against(items: list[tuple[int, str]]) -> DataFrame:
        sent = documents.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_WORDS words, or one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(sent.value, min_match)
            schema = pa.schema([("row_key", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("item_words", pa.int32()), ("tiles", pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())])))])
            for batch in batches:
                for piece in slices(batch):
                    out = [
                        (piece.column("row_key")[text].as_py(), block.ids[k], share, len(block.words[k]), [{"item_at": a, "doc_at": b, "words": n} for a, b, n in tiles])
                        for text, k, share, tiles in block.covered(piece.column("text"), min_match, threshold)
                    ]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        return rows.mapInArrow(run, FOUND)

    bounded_batches(documents.sparkSession)
    blocks = [against(b) for b in _blocks(benchmark)]
    found = reduce(DataFrame.unionByName, blocks) if blocks else documents.sparkSession.createDataFrame([], FOUND)
    return found.withColumnRenamed("row_key", key)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, min_match: int = 4, threshold: float = 0.5) -> DataFrame:
    """The rows of documents that hold no item, with all columns; each row is judged in place.

    Null and empty texts hold nothing and stay; null ids, repeated rows and columns of any name pass through; a coverage equal to
    the threshold counts as held; a text of any length is compared whole; an empty table gives no rows, an empty benchmark all.
    """
    bounded_batches(documents.sparkSession)
    out = packed_rows(documents)
    for items in _blocks(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_WORDS words, or one item
        out = out.mapInArrow(_without(sent, min_match, threshold), out.schema)
    return unpacked_rows(out, documents.columns)


def _without(sent, min_match: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        block = Block(sent.value, min_match)
        for batch in batches:
            for piece in slices(batch):
                keep = np.ones(len(piece), bool)
                for text, *_ in block.covered(piece.column("text"), min_match, threshold):
                    keep[text] = False
                yield piece.filter(pa.array(keep))

    return run
