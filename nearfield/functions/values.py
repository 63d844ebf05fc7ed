"""Small functions on values: bytes of primitives, the middle value, Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of each kind; all are big-endian.
WIDTHS = {"byte": 1, "short": 2, "int": 4, "long": 8, "float": 4, "double": 8}
FLOATS = {"float": ">f4", "double": ">f8"}


def to_bytes(value: Column, kind: str) -> Column:
    """The value as big-endian bytes, whole numbers in two's complement."""
    width = WIDTHS[kind]
    if kind not in FLOATS:
        digits = F.lpad(F.hex(value.cast("long")), 16, "0")
        return F.unhex(F.right(digits, F.lit(2 * width)))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            flat = part.to_numpy(dtype=FLOATS[kind], na_value=np.nan).tobytes()
            yield pd.Series([None if gone else flat[i * width : (i + 1) * width] for i, gone in enumerate(part.isna())])

    made = F.pandas_udf(run, "binary", F.PandasUDFType.SCALAR_ITER)
    return made(value.cast(kind))


def from_bytes(data: Column, kind: str) -> Column:
    """What to_bytes wrote."""
    width = WIDTHS[kind]
    if kind not in FLOATS:
        negative = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int") >= 128
        digits = F.when(negative, F.lpad(F.hex(data), 16, "F")).otherwise(F.lpad(F.hex(data), 16, "0"))
        return F.conv(digits, 16, -10).cast(kind)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if b is None else float(np.frombuffer(b, FLOATS[kind], 1)[0]) for b in part], dtype=object)

    return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)(data)


def middle(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The smallest value that at least half of the rows don't exceed."""
    return rows.groupBy(*(by or [])).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)").alias("middle"))


def _places(value: Column, power: int, hashes: int) -> Column:
    return F.array(*[F.shiftrightunsigned(F.xxhash64(value, F.lit(i)), 64 - power) for i in range(hashes)])


def bloom_filter(rows: DataFrame, value: str, power: int = 20, hashes: int = 4) -> DataFrame:
    """(word, bits): the words of a Bloom filter of 2 ** power bits that aren't zero; partial words are combined before the shuffle."""
    at = rows.where(F.col(value).isNotNull()).select(F.explode(_places(F.col(value), power, hashes)).alias("at"))
    return at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits"))


def bloom_candidates(rows: DataFrame, value: str, words: DataFrame, power: int = 20, hashes: int = 4) -> DataFrame:
    """Rows whose value may be in the filter: none that is in it is missed, few others pass."""
    spark = rows.sparkSession
    kept = {r[0]: r[1] for r in words.collect()}  # at most 2 ** (power - 6) words
    table = np.zeros(1 << (power - 6), np.int64)
    table[list(kept)] = list(kept.values())
    sent = spark.sparkContext.broadcast(table)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            at = np.array(part.tolist(), np.int64).reshape(len(part), hashes)
            yield pd.Series(((sent.value[at >> 6] >> (at & 63)) & 1).all(1))

    known = rows.where(F.col(value).isNotNull())
    return known.where(F.pandas_udf(run, "boolean", F.PandasUDFType.SCALAR_ITER)(_places(F.col(value), power, hashes)))
