"""Cheap images of objects: bit sketches, permutations, pivot tuples, and their distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits in one word; a sketch of more bits is an array of words.
WORD = 62


def bit_sketch(tuple_: Column, bits: int) -> Column:
    """Bit i is set where the distance to pivot 2i is larger than to pivot 2i + 1; one bigint for up to WORD bits."""
    words = [
        reduce(Column.__add__, [F.when(tuple_[2 * i] > tuple_[2 * i + 1], F.lit(1 << (i - low)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(low, min(bits, low + WORD))])
        for low in range(0, bits, WORD)
    ]
    return words[0] if len(words) == 1 else F.array(*words)


def hyperplane_bounds(tuple_: Column, bits: int) -> Column:
    """For every bit, the lower bound of the distance to the hyperplane between its pivots."""
    return F.array(*[F.abs(tuple_[2 * i] - tuple_[2 * i + 1]) / 2 for i in range(bits)])


def differs(a: Column, b: Column, i: Column, bits: int) -> Column:
    """Whether bit i of two sketches differs."""
    word = (lambda x: x) if bits <= WORD else (lambda x: x[(i / WORD).cast("int")])
    return F.getbit(word(a).bitwiseXOR(word(b)), i % WORD) == 1


def sketch_bound(bounds: Column, a: Column, b: Column, bits: int) -> Column:
    """The lower bound of the distance from the object that bounds belongs to, to objects of sketch b: the farthest hyperplane that
    parts a and b."""
    return F.array_max(F.transform(bounds, lambda d, i: F.when(differs(a, b, i, bits), d).otherwise(0.0)))


def hamming(a: Column, b: Column, bits: int = WORD) -> Column:
    """Bits that differ; sketches of more than WORD bits are arrays of words."""
    if bits <= WORD:
        return F.bit_count(a.bitwiseXOR(b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def permutation(tuple_: Column) -> Column:
    """Pivot numbers in order of (distance, number)."""
    ranked = F.array_sort(F.transform(tuple_, lambda d, i: F.struct(d.alias("d"), i.alias("i"))))
    return F.transform(ranked, lambda x: x["i"])


def footrule(a: Column, b: Column) -> Column:
    """Spearman's footrule of two permutations."""
    moved = F.transform(a, lambda v, i: F.abs(i - (F.array_position(b, v) - 1)))
    return F.aggregate(moved, F.lit(0).cast("bigint"), lambda s, x: s + x)


def rectangle(tuple_: Column, radius: float, largest: float = float("inf")) -> tuple[Column, Column]:
    """Ends of the query rectangle in pivot space."""
    low = F.transform(tuple_, lambda s: F.greatest(s - F.lit(radius), F.lit(0.0)))
    return low, F.transform(tuple_, lambda s: F.least(s + F.lit(radius), F.lit(largest)))


def overlaps(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Whether two rectangles meet in every dimension."""
    first = F.forall(F.zip_with(low, other_high, lambda x, y: x <= y), lambda x: x)
    return first & F.forall(F.zip_with(other_low, high, lambda x, y: x <= y), lambda x: x)
