"""Tokenizing by distinct space-separated chunks.

A chunk is what stands between two spaces. For the two vocabularies used here the ids of a text are the ids of its chunks in
order, so each distinct chunk is tokenized once and whole batches are assembled with array gathers. Where that doesn't hold
(a document with runs of white space, control separators or special strings under the byte vocabulary) the library encodes the
whole text; a chunk with characters outside printable Latin-1 is encoded by the library as well.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from nearfield.llm.common import gather

#: Chunks kept in memory by one Python worker, and the longest one kept; the older half is dropped when it is full.
CACHE_CHUNKS, CACHE_LENGTH = 400_000, 64
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*\Z")
#: The pre-tokenizer patterns of the two vocabulary files.
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space after a space, a space at the end, or a special string: chunks aren't independent under the byte vocabulary.
BOUND = r"[ ][\s\x0b\x1c-\x1f\x{85}\p{Z}]|[ ]$|^[ ]|[\x1c-\x1f\x{85}]|<\|endoftext\|>"


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for the 256 byte values, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


ALPHABET = byte_alphabet()


def as_bytes_text(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(ALPHABET)


class HalvingCache(dict):
    """Entries found again survive one halving; memory stays under the stated number of entries of short keys. Long ones aren't kept."""

    def __init__(self, make: Callable[[str], object], most: int = CACHE_CHUNKS):
        super().__init__()
        self.make, self.half, self.old = make, most // 2, {}

    def __missing__(self, key: str):
        if len(key) > CACHE_LENGTH:
            return self.make(key)
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ChunkEncoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        pieces = str(self.library.pre_tokenizer)
        self.words = "ByteLevel" in pieces and "Split" in pieces
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = HalvingCache(self._piece, most)
        self.first = HalvingCache(self._chunk, most)
        self.rest = self.first if self.words else HalvingCache(lambda chunk: self._chunk(" " + chunk), most)

    def _piece(self, piece: str) -> bytes:
        spelled = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else as_bytes_text(piece)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.strip(" ").isalpha():
            return self._piece(chunk.lower() if self.words else chunk)
        if not PLAIN.match(chunk) or "<|" in chunk:
            return self.whole(chunk).tobytes()
        found = WORD_PIECES.findall(chunk.lower()) if self.words else BYTE_PIECES.findall(chunk)
        if len(found) == 1:
            return self._piece(found[0])
        return b"".join([self.pieces[p] for p in found])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the column on end, and the number of ids of each; null counts as the empty text."""
        column = pc.fill_null(column, "")
        odd = np.zeros(len(column), bool) if self.words else np.asarray(pc.match_substring_regex(column, BOUND))
        whole = [self.whole(t) for t in column.filter(pa.array(odd)).to_pylist()]
        if whole:
            column = pc.if_else(pa.array(odd), "", column)
        lists = pc.split_pattern(column, " ")
        counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        index = np.asarray(coded.indices)
        distinct = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        chunks = pc.binary_join(distinct, " ")[0].as_py().split(" ")  # chunks hold no space
        heads = np.cumsum(counts) - counts
        values = [self.rest[c] for c in chunks]
        if self.words:
            at = index
        else:  # the first chunk of a text has no space before it
            at = index.astype(np.int64)
            starts, inverse = np.unique(index[heads], return_inverse=True)
            at[heads] = len(values) + inverse
            values += [self.first[chunks[i]] for i in starts.tolist()]
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        pool = np.frombuffer(b"".join(values), "<u4")
        begin = np.cumsum(size) - size
        lengths = size[at]
        ids = gather(begin[at], lengths, pool)
        per_text = np.add.reduceat(lengths, heads) if len(heads) else np.zeros(0, np.int64)
        if not whole:
            return ids, per_text
        ends, parts, done, out = np.cumsum(per_text), [], 0, per_text.copy()
        for i, own in zip(np.flatnonzero(odd).tolist(), whole, strict=True):
            parts += [ids[done : ends[i] - per_text[i]], own]
            done, out[i] = ends[i], len(own)
        return np.concatenate([*parts, ids[done:]]), out


_made: dict[str, ChunkEncoder] = {}


def encoder(name: str) -> ChunkEncoder:
    """One encoder for each vocabulary and Python worker; name is a file of public_tokenizers."""
    if name not in _made:
        _made[name] = ChunkEncoder(public_tokenizers.path(name))
    return _made[name]
