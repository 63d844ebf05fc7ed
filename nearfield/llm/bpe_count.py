"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

A piece starts as one symbol for each byte. The adjacent pair of lowest rank is popped from a heap and merged, its neighbours in
the linked list form new pairs, and stale heap entries are passed over. The count is the symbols at the start minus the merges.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearfield.llm.chunks import PLAIN, WORD_PIECES, HalvingCache, as_bytes_text
from nearfield.llm.common import bounded_batches, slices

COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class MergeCounter:
    """Counts as Tokenizer.encode(text, add_special_tokens=False) of a word-level byte-pair vocabulary gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            kept = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = kept["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in kept["added_tokens"]) or r"(?!)")
        self.chunks = HalvingCache(self._chunk)

    def merges(self, piece: str) -> int:
        """Tokens of one piece, spelled in the byte alphabet."""
        symbols = [*piece[:-1], piece[-1] + self.end]
        n = count = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks, heap = self.ranks, []
        # A heap entry is rank << 32 | place; it is stale unless the pair that stands there now has that rank.
        for i in range(n - 1):
            if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None:
                heap.append(rank << 32 | i)
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or symbols[i] is None or ranks.get((symbols[i], symbols[j])) != entry >> 32:
                continue
            symbols[i], symbols[j] = symbols[i] + symbols[j], None
            after[i] = k = after[j]
            count -= 1
            if k >= 0:
                before[k] = i
                if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, rank << 32 | h)
        return count

    def _chunk(self, chunk: str) -> int:
        if chunk.isascii() and chunk.isalpha():
            return self.merges(chunk.lower())
        if "<|" in chunk and (found := self.special.findall(chunk)):
            return len(found) + sum(self._chunk(x) for x in self.special.split(chunk) if x)
        if PLAIN.match(chunk):
            return sum(self.merges(as_bytes_text(x)) for x in WORD_PIECES.findall(chunk.lower()))
        whole = self.library.normalizer.normalize_str(chunk)
        return sum(self.merges(x) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(whole))

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text; a null counts as the empty text."""
        lists = pc.split_pattern(pc.fill_null(column, ""), " ")
        sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        if not len(sizes):
            return sizes
        coded = pc.list_flatten(lists).dictionary_encode()
        distinct = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        values = np.array([self.chunks[c] for c in pc.binary_join(distinct, " ")[0].as_py().split(" ")], np.int64)
        return np.add.reduceat(values[np.asarray(coded.indices)], np.cumsum(sizes) - sizes)


_made: dict[str, MergeCounter] = {}


def counter(vocabulary: str) -> MergeCounter:
    if vocabulary not in _made:
        _made[vocabulary] = MergeCounter(public_tokenizers.path(vocabulary))
    return _made[vocabulary]


def count_tokens(documents: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more than limit tokens.

    A null text has no bytes and no tokens; a null doc_id stays null; repeated rows are counted each; equal ranks merge from the
    left; a run of letters of any length is merged whole, with about 200 bytes of memory for each of its bytes; an empty table gives
    no rows; other columns are ignored.
    """

    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(vocabulary)
        for batch in batches:
            for piece in slices(batch):
                n = tool.count(piece.column("text"))
                size = pc.fill_null(pc.binary_length(piece.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTED)
