"""Distances as column expressions, and the registry that search operators look them up in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column], start: Column) -> Column:
    """Left-to-right sum of a term over two arrays of equal length, in double or bigint."""
    return F.aggregate(F.zip_with(a, b, term), start, lambda s, x: s + x)


def l1(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")), F.lit(0.0))


def l1_integer(a: Column, b: Column, largest: int | None = None) -> Column:
    """L1 over integers in bigint; with largest, a sum beyond it raises (narrow result types never wrap)."""
    total = _fold(a, b, lambda x, y: F.abs(x.cast("bigint") - y.cast("bigint")), F.lit(0).cast("bigint"))
    if largest is None:
        return total
    return F.when(total <= largest, total).otherwise(F.raise_error(F.lit(f"distance is over {largest}")))


def l2(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.sqrt(_fold(a, b, term, F.lit(0.0)))


def l_infinity(a: Column, b: Column) -> Column:
    """Largest difference; empty arrays are 0 apart."""
    return F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))), F.lit(0.0))


def edit_distance(a: Column, b: Column, limit: int | None = None) -> Column:
    """Levenshtein with unit costs; -1 beyond limit."""
    return F.levenshtein(a, b, limit) if limit is not None else F.levenshtein(a, b)


def protein(a: Column, b: Column) -> Column:
    return edit_distance(a, b).cast("float")


def position_map(text: Column) -> Column:
    """character -> sorted positions, from a string."""
    letters = F.split(text, "")
    places = F.transform(letters, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.map_from_entries(F.transform(F.array_distinct(letters), lambda c: F.struct(c, F.transform(F.filter(places, lambda p: p["c"] == c), lambda p: p["i"]))))


def closest_positions(a: Column, b: Column) -> Column:
    """Mean of both directions of: for every place of a character the distance to its closest place in the other map, 1 for each
    missing character. Not a metric."""

    def one(x: Column, y: Column) -> Column:
        def cost(key: Column, places: Column) -> Column:
            other = F.element_at(y, key)
            near = F.aggregate(places, F.lit(0), lambda s, p: s + F.array_min(F.transform(other, lambda o: F.abs(o - p))))
            return F.when(other.isNull(), F.size(places)).otherwise(near)

        return F.aggregate(F.transform(F.map_entries(x), lambda e: cost(e["key"], e["value"])), F.lit(0), lambda s, v: s + v)

    return (one(a, b) + one(b, a)).cast("double") / 2


def sparse_l1(a: Column, b: Column) -> Column:
    """L1 of two maps term -> count."""
    merged = F.map_zip_with(a, b, lambda _, x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("bigint"))
    return F.aggregate(F.map_values(merged), F.lit(0).cast("bigint"), lambda s, x: s + x)


def tanimoto(a: Column, b: Column) -> Column:
    """1 - ab / (aa + bb - ab) over maps term -> count."""

    def dot(x: Column, y: Column) -> Column:
        values = F.map_values(F.map_zip_with(x, y, lambda _, p, q: (F.coalesce(p, F.lit(0)) * F.coalesce(q, F.lit(0))).cast("double")))
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    ab = dot(a, b)
    rest = dot(a, a) + dot(b, b) - ab
    return F.when(rest == 0, 0.0).otherwise(1 - ab / rest)


@dataclass(frozen=True)
class Distance:
    """A distance by name; pruning by the triangle inequality is allowed for metrics only."""

    of: Callable[[Column, Column], Column]
    is_metric: bool
    kernel: str | None = None  # the array kernel that gives the same values


DISTANCES: dict[str, Distance] = {
    "l1": Distance(l1, True, "l1"),
    "l2": Distance(l2, True, "l2"),
    "linf": Distance(l_infinity, True, "linf"),
    "l1_integer": Distance(l1_integer, True),
    "levenshtein": Distance(edit_distance, True),
    "protein": Distance(protein, True),
    "positions": Distance(closest_positions, False),
    "sparse_l1": Distance(sparse_l1, True),
    "tanimoto": Distance(tanimoto, False),
}


def register(name: str, of: Callable[[Column, Column], Column], is_metric: bool) -> None:
    """A distance of the user's own: native columns, or a pandas_udf marked nondeterministic so that it runs once."""
    DISTANCES[name] = Distance(of, is_metric)
