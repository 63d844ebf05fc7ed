"""Words of whole batches as 64-bit hashes, and hashes of windows of words, on byte arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; a word that is longer widens its block.
BLOCK = 1_000_000
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
#: White space of ASCII becomes a blank, A-Z become lower case.
PLAIN = np.array([32 if b in b"\t\n\x0b\x0c\r " else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: All of ASCII but letters and digits becomes a blank, A-Z become lower case.
SPOKEN = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _hash_block(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words between the blanks of a block."""
    n = 1 << max(10, int(len(block) + 1).bit_length())
    if n not in _kept:
        _kept.clear()
        _kept[n] = _powers(_BASE, n), _powers(_BACK, n)
    ahead, back = _kept[n]
    inside = np.r_[False, block != 32, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.r_[np.uint64(0), np.cumsum(_VALUES[block] * ahead[: len(block)], dtype=np.uint64)]
    return starts, mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def hashed_words(column: pa.Array, spoken: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts on end, and the number of words of each; null counts as the empty text.

    Words are runs of all but ASCII white space with A-Z in lower case; or, if spoken, runs of letters and digits in lower case,
    which ASCII, Latin-1 and general punctuation separate.
    """
    column = pc.fill_null(column, "").cast(pa.string())
    if spoken:
        column = pc.utf8_lower(column)
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.asarray(pc.binary_length(column)).astype(np.int64)
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), "\n")[0].as_buffer()
    raw = np.frombuffer(raw, np.uint8)
    begin, starts, hashes = 0, [], []
    while begin < len(raw):
        width = BLOCK
        while True:
            block = (SPOKEN if spoken else PLAIN)[raw[begin : begin + width]]
            if begin + width >= len(raw):
                break
            blanks = np.flatnonzero(block == 32)
            if len(blanks):
                block = block[: blanks[-1] + 1]
                break
            width *= 2
        if spoken:
            wide = np.flatnonzero(block == 0xC2)
            block[wide] = 32
            block[np.minimum(wide + 1, len(block) - 1)] = 32
            marks = np.flatnonzero((block[:-2] == 0xE2) & (block[1:-1] == 0x80))
            for k in range(3):
                block[marks + k] = 32
        own, found = _hash_block(block)
        starts.append(own + begin)
        hashes.append(found)
        begin += len(block)
    places = np.concatenate([*starts, np.zeros(0, np.int64)])
    heads = np.r_[0, np.cumsum(sizes + 1)]
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.diff(np.searchsorted(places, heads))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the words [i, i + size) for every i, without regard to where texts end."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * ODD + words[k : k + n]
    return mixed(out)
