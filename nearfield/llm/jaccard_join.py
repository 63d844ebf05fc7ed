"""Near duplicates: an exact join of word-shingle sets on Jaccard similarity, in size-banded tiles with bitmap signatures.

1. Every document becomes a sorted array of 64-bit shingle hashes. Documents of equal sets form one class; its smallest row stands
   for it from here on.
2. Stars: classes that share one of their smallest hashes are compared with two centres of that hash, exactly: its first class, and
   the class whose bitmap is nearest to that one's. Among copies with changes of their own, the difference from the first class
   grows with a copy's changes, so the second centre is a copy with few changes, which links with most others. The links give first
   components, so that a large group of near copies costs a few comparisons for each member.
3. Prefixes: two linked sets share a hash among the first s - ceil(0.8 s) + 1 of each, in any fixed order of hashes (the prefix
   filter); common ones go last in our order, by counts in hashed buckets. Only a hash whose holders lie in two or more components
   can still show a new link. Such hashes, joined with a band of set sizes, are the tiles: a set meets the sets of its own and the
   next band, from another component.
4. In a tile, parity bitmaps of 512 bits bound the overlap from above: each bit that differs witnesses an element outside the
   intersection. Two sets of many common hashes would meet in as many tiles: a row carries the few keys before this one in its own
   order, and a pair that has one of those in common is left to the earlier tile; at its first common key it has none, so it is
   met at least once. The smaller set of a pair shares s - ceil(2 * 0.8 / 1.8 * s) + 1 at least of its s hashes, so it needs only
   that part of its prefix. Bitmaps of 512 bits say little of sets of thousands: pairs that pass meet again by bitmaps as wide as
   their sets, and only those that pass these too are compared exactly on their sorted arrays, for which texts are shuffled.
5. A tile of more than CROWD sets makes no rows of pairs, which would grow with the square of a group: its sets are dealt into cells
   of bounded size, and a set of a cell that some other may link with by its bitmap brings its text there once. A cell compares all
   such pairs exactly, and gives only links that join two components.
6. All links give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from nearfield.llm.common import Scratch, forget_tokenizers, gather, give_back, packed_rows, slices, unpacked_rows
from nearfield.llm.components import components
from nearfield.llm.words import hashed_words, mixed, window_hashes

BANDS = 8  # 64-bit words of a bitmap
STARS = 4
#: Buckets of the frequency order, and the largest bit filter of tile hashes (bits as a power of two); both sizes are fixed.
ORDER_BUCKETS, ORDER_SLICES = 1 << 20, 64
FILTER_POWER = 29
#: Bands of tiles as a power of the largest ratio of linked sizes.
BAND_POWER = 4
#: Earlier keys of its own that a row of a tile carries.
BEFORE = 3
#: Rows of a tile that is still joined pair by pair; the rows and hashes of a block of a larger one, two of which make a cell.
CROWD = 32
BLOCK_ROWS, BLOCK_HASHES = 2_048, 1 << 20
MADE = "n int, d0 long, d1 long, stars array<long>, bits array<long>, counted binary"
MADE_ARROW = [("n", pa.int32()), ("d0", pa.int64()), ("d1", pa.int64()), ("stars", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("counted", pa.binary())]


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one hash of all words where there are fewer than size."""
    words, counts = hashed_words(column)
    windows = window_hashes(words, size)
    sets, end = [], 0
    for n in counts.tolist():
        begin, end = end, end + n
        if n >= size:
            own = np.sort(windows[begin : end - size + 1])
            sets.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:
            sets.append(window_hashes(words[begin:end], n) if n else words[:0])
    return sets


def parity_bits(own: np.ndarray, width: int = 64 * BANDS) -> np.ndarray:
    """Parities of the hashes by their low bits; width is a power of two."""
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide_bits(own: np.ndarray) -> bytes:
    """Parities in one bit for each hash at least, 64 at least; half of a bitmap is the sum of its halves."""
    return parity_bits(own, 1 << max(6, (max(1, len(own)) - 1).bit_length())).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """The bits that differ, at the width of the narrower bitmap."""
    a, b = sorted((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _signatures(size: int):
    """The columns of MADE beside each row of (doc_id, text, row); bucket counts travel as extra rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        totals, schema = np.zeros(ORDER_BUCKETS, np.int64), None
        for batch in batches:
            schema = schema or pa.schema([*batch.schema, *MADE_ARROW])
            for piece in slices(batch, limit=1_000_000):
                columns: list[list] = [[], [], [], [], []]
                sets = shingle_sets(piece.column("text"), size)
                for own in sets:
                    # Two checksums of the whole set, 128 bits together.
                    low = int(own.sum(dtype=np.uint64)) if len(own) else 0
                    high = int(np.bitwise_xor.reduce(own * (own | np.uint64(1)))) if len(own) else 0
                    for c, v in zip(columns, (len(own), low - (low >> 63 << 64), high - (high >> 63 << 64), signed(own[:STARS]), parity_bits(own)), strict=True):
                        c.append(v)
                totals += np.bincount((np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(44)).astype(np.int64), minlength=ORDER_BUCKETS)
                made = [pa.array(c, kind) for c, (_, kind) in zip(columns, MADE_ARROW, strict=False)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made, pa.nulls(len(piece), pa.binary())], schema=schema)
        if totals.any():
            # The task's bucket counts, one row for each slice of buckets; they are added up below.
            parts = totals.astype("<i8").reshape(ORDER_SLICES, -1)
            yield pa.RecordBatch.from_pylist([{"n": i, "counted": own.tobytes()} for i, own in enumerate(parts)], schema=schema)
        give_back()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, row in zip(batch.column("part").to_pylist(), batch.column("counted"), strict=True):
            own = np.frombuffer(row.as_buffer(), "<i8")
            totals[part] = totals[part] + own if part in totals else own
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array([*totals], pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["part", "counted"])


def _verified(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of rows whose sets reach the similarity; texts come along and arrays are built where they are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "ta", 1_000_000):
                left, right = piece.column("ta").dictionary_encode(), piece.column("tb").dictionary_encode()
                a_sets, b_sets = shingle_sets(left.dictionary, size), shingle_sets(right.dictionary, size)
                keep = []
                for i, j in zip(left.indices.to_pylist(), right.indices.to_pylist(), strict=True):
                    x, y = a_sets[i], b_sets[j]
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(both) - common))
                yield piece.select(["a", "b"]).filter(pa.array(keep))
        give_back()

    met = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    own = _inside(sets.select("rid", "text"), _members(met))  # other texts need not be shuffled
    a = own.select(F.col("rid").alias("a"), F.col("text").alias("ta"))
    b = own.select(F.col("rid").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that wide bitmaps allow. A bitmap is some 20 times smaller than its text, which isn't shuffled for others."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.filter(pa.array(_among(batch, members.value))), limit=1_000_000):
                own = shingle_sets(piece.column("text"), size)
                yield pa.RecordBatch.from_arrays([piece.column("rid"), pa.array([len(x) for x in own], pa.int64()), pa.array(map(wide_bits, own), pa.binary())], ["rid", "n", "wide"])
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
            apart = np.array([bits_apart(x, y) for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * (total - apart) >= 2 * percent * total))

    members = _members(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct())
    own = sets.select("rid", "text").mapInArrow(described, "rid long, n long, wide binary")
    a = own.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
    b = own.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long")


def _differing() -> Column:
    return sum((F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(BANDS)), F.lit(0))


def _close_enough(percent: int) -> Column:
    """Sizes allow the similarity, and so do the bits that differ: overlap <= (na + nb - differing bits) / 2."""
    differ = _differing()
    total = F.col("na") + F.col("nb")
    sizes = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sizes & ((100 + percent) * (total - differ) >= 2 * percent * total)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def smaller_prefix_length(n: int, percent: int) -> int:
    """The prefix that meets sets of at least n hashes: they share 2 * percent / (100 + percent) of n at least."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _prefixes(size: int, percent: int, order, wanted=None, without=None):
    """Rows (key, component) of every set; with a bit filter of hashes, only those that pass it, with what a tile needs.

    Rows that may be among the members of without are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        common = order.value
        for batch in batches:
            if without:
                batch = batch.filter(pa.array(~_among(batch, without.value)))
            for piece in slices(batch, limit=1_000_000):
                sets = shingle_sets(piece.column("text"), size)
                keys, rows, before, early = [], [], [], []
                for row, own in enumerate(sets):
                    if not len(own):
                        continue
                    k = prefix_length(len(own), percent)
                    if k < len(own):  # own is in order of hash, so equal counts stay so
                        own = own[np.argsort(common[own >> np.uint64(44)], kind="stable")[:k]]
                    if wanted:
                        hit = np.flatnonzero(_hits(own, wanted.value))
                        early.append(hit < smaller_prefix_length(len(sets[row]), percent))
                        own = own[hit]
                        before += [signed(own[max(0, i - BEFORE) : i]) for i in range(len(own))]
                    keys.append(own)
                    rows.append(np.full(len(own), row, np.int64))
                if not keys:
                    continue
                key, row = np.concatenate(keys), pa.array(np.concatenate(rows))
                if not wanted:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), piece.column("comp").take(row)], ["key", "comp"])
                elif len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), *(piece.column(c).take(row) for c in ("comp", "rid", "n", "bits")), pa.array(before, pa.list_(pa.int64())), pa.array(np.concatenate(early))], ["key", "comp", "rid", "n", "bits", "before", "early"])
        give_back()

    return run


def _bit_filter(keys: DataFrame):
    """(shift, bytes): one bit for each range of 64-bit keys that holds a wanted one. Its size is bounded by FILTER_POWER."""
    power = min(FILTER_POWER, max(16, (48 * keys.count()).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - power)
    words = keys.select(slot.alias("s")).select(F.expr("shiftright(s, 6)").alias("w"), F.expr("shiftleft(1L, cast(s % 64 AS int))").alias("b"))
    words = words.groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    found = words.toArrow()
    bits = np.zeros(1 << (power - 6), np.int64)
    bits[np.asarray(found.column("w"))] = np.asarray(found.column("b"))
    return np.uint64(64 - power), bits.view(np.uint8)


def _hits(keys: np.ndarray, wanted) -> np.ndarray:
    shift, bits = wanted
    at = keys >> shift
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(signed(mixed(np.asarray(batch.column("rid")).astype(np.uint64))))], ["key"])


def _among(batch: pa.RecordBatch, wanted) -> np.ndarray:
    return _hits(mixed(np.asarray(batch.column("rid")).astype(np.uint64)), wanted)


def _members(rows: DataFrame):
    """A bounded bit filter of the rids of rows: tells rows surely outside from rows that may be among them."""
    return rows.sparkSession.sparkContext.broadcast(_bit_filter(rows.select("rid").mapInArrow(_spread, "key long")))


def _inside(table: DataFrame, wanted, inside: bool = True) -> DataFrame:
    """The rows of table that may be among the members; or those that surely aren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_among(batch, wanted.value) == inside))

    return table.mapInArrow(run, table.schema)


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of each value of a column by which they are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        own = np.asarray(batch.column(column))
        ends = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for begin, end in zip(ends, ends[1:], strict=False):
            if held and held[0].column(column)[0].as_py() != own[begin]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.concat_batches(held)


def _bitmaps_close(n: np.ndarray, bits: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """What _close_enough says of row i and the others."""
    most, least, total = np.maximum(n[i], n[others]), np.minimum(n[i], n[others]), n[i] + n[others]
    apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
    return (100 * least >= percent * most) & ((100 + percent) * (total - apart) >= 2 * percent * total)


def _crowded(entries: DataFrame, crowds: DataFrame) -> DataFrame:
    """The rows of large tiles in their cells. Blocks of a tile meet two by two: a row is repeated for each block, not for each row."""
    blocks = F.ceil(F.col("held") / F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_HASHES) / F.col("largest"))))).cast("int")
    own = entries.join(crowds, ["key", "tile"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    cell = F.xxhash64("key", "tile", F.least("block", "other"), F.greatest("block", "other"))
    return met.select(cell.alias("cell"), side.alias("side"), "rid", "comp", "n", "bits", "before", "smaller")


def _cell_members(percent: int):
    """Rows (cell, side, rid, comp) of the sets that some other set of their cell may link with, by the rules of the pairwise join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, "cell"):
            rid, comp, side, smaller = (np.asarray(group.column(c).to_numpy(zero_copy_only=False)) for c in ("rid", "comp", "side", "smaller"))
            n = np.asarray(group.column("n")).astype(np.int64)
            bits = np.asarray(group.column("bits").flatten()).view(np.uint64).reshape(-1, BANDS)
            counts = np.diff(np.asarray(group.column("before").offsets))
            before = np.zeros((len(rid), BEFORE), np.int64)
            has = np.arange(BEFORE) < counts[:, None]
            before[has] = np.asarray(group.column("before").flatten())
            found = np.zeros(len(rid), bool)
            for i in np.flatnonzero(smaller).tolist():
                met = np.flatnonzero((comp != comp[i]) & ((n > n[i]) | ((n == n[i]) & (rid > rid[i]))) & ((side != side[i]) | (side[i] == 0)))
                met = met[_bitmaps_close(n, bits, i, met, percent)]
                if len(met) and counts[i]:
                    met = met[~((before[met][:, :, None] == before[i, : counts[i]]) & has[met][:, :, None]).any(axis=(1, 2))]
                if len(met):
                    found[met] = found[i] = True
            yield group.select(["cell", "side", "rid", "comp"]).filter(pa.array(found))

    return run


def _cell_links(size: int, percent: int):
    """Links (a, b) between components of a cell, by exact comparison; no two of them join the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, "cell"):
            sets = [own for piece in slices(group, limit=1_000_000) for own in shingle_sets(piece.column("text"), size)]
            rid, comp, side = (np.array(group.column(c)) for c in ("rid", "comp", "side"))
            n = np.array([len(x) for x in sets], np.int64)
            bits = np.array([parity_bits(x) for x in sets]).view(np.uint64)
            distinct, pool = np.unique(np.concatenate(sets), return_inverse=True)
            starts, here, links = np.cumsum(n) - n, np.zeros(len(distinct), bool), []
            for i in range(len(sets) - 1):
                later = np.arange(i + 1, len(sets))
                later = later[(comp[later] != comp[i]) & ((side[later] != side[i]) | (side[i] == 0))]
                later = later[_bitmaps_close(n, bits, i, later, percent)]
                if not len(later):
                    continue
                own = pool[starts[i] : starts[i] + n[i]]
                here[own] = True
                common = np.add.reduceat(here[gather(starts[later], n[later], pool)], np.cumsum(n[later]) - n[later], dtype=np.int64)
                here[own] = False
                for j in later[100 * common >= percent * (n[i] + n[later] - common)].tolist():
                    if comp[j] != comp[i]:
                        comp[comp == comp[j]] = comp[i]
                        links.append((rid[i], rid[j]))
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        give_back()

    return run


def _stars(sets: DataFrame, percent: int, store: Scratch) -> DataFrame:
    """Pairs (a, b) of rows close enough by their bitmaps, each a centre of a hash and another holder of it."""
    about = sets.select("rid", "n", "bits")

    def described(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(about.select(F.col("rid").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"{side}_bits")), side)
        return pairs

    small = sets.select("rid", F.explode("stars").alias("key"))
    # Tables are written before the joins that may meet a large group, so that Spark can split its rows.
    centres = store.step(small.groupBy("key").agg(F.min("rid").alias("a"), F.count("*").alias("held")).where("held > 1"), "centres")
    first = described(small.join(centres, "key").where("rid <> a").select("key", "held", "a", F.col("rid").alias("b")))
    first = store.step(first.select("key", "held", "a", "b", (_differing() / (F.col("na") + F.col("nb"))).alias("apart"), _close_enough(percent).alias("close")), "first-spokes")
    nearest = first.where("held > 2").groupBy("key").agg(F.min(F.struct("apart", "b")).alias("least")).select("key", F.col("least.b").alias("centre"))
    nearest = store.step(nearest, "second-centres")
    second = small.join(nearest, "key").where("rid <> centre").select(F.least("rid", "centre").alias("a"), F.greatest("rid", "centre").alias("b")).distinct()
    second = described(second).where(_close_enough(percent)).select("a", "b")
    return store.step(first.where("close").select("a", "b").unionByName(second).distinct(), "star-pairs")


def _classified(rows: DataFrame, size: int, percent: int, store: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, n, class_size, root) of every row of (doc_id, text, ...), and the written rows with their rid.

    All tables but these two are deleted again.
    """
    spark = rows.sparkSession
    made = StructType([StructField(f.name, f.dataType) for f in rows.schema] + StructType.fromDDL(MADE).fields)
    made = store.step(rows.mapInArrow(_signatures(size), made).withColumn("rid", F.monotonically_increasing_id()), "sets")
    everyone = made.where("counted is null")

    counted = made.where("counted is not null").select(F.col("n").alias("part"), "counted")
    summed = dict(map(tuple, counted.repartition(ORDER_SLICES, "part").mapInArrow(_added, "part int, counted binary").collect()))
    weights = np.concatenate([np.frombuffer(summed[i], "<i8") for i in range(ORDER_SLICES)]) if summed else np.zeros(ORDER_BUCKETS, np.int64)
    order = spark.sparkContext.broadcast(weights)

    full = everyone.where("n > 0")
    # Aggregates are written before they are joined back: between plain tables Spark can split the rows of a large group.
    classes = store.step(full.groupBy("n", "d0", "d1").agg(F.min("rid").alias("head"), F.count("*").alias("class_size")).where("class_size > 1"), "repeated")
    member = store.step(everyone.select("rid", "doc_id", "n", "d0", "d1").join(classes, ["n", "d0", "d1"], "left").select("rid", "doc_id", "n", F.coalesce("head", "rid").alias("head"), F.coalesce("class_size", F.lit(1)).alias("class_size")), "classes")
    copies = member.where("rid <> head").select("rid")
    sets = full.join(copies, "rid", "left_anti").select("rid", "n", "stars", "bits")
    first_links = store.step(_verified(_stars(sets, percent, store), full, size, percent), "star-links")
    first = components(first_links, store)

    # Prefixes: hashes whose holders lie in several components.
    store.sweep()
    texts = full.select("rid", "n", "bits", "text")
    special = _members(copies.unionByName(first.select(F.col("node").alias("rid"))))
    some = _inside(texts, special).join(copies, "rid", "left_anti").join(first.withColumnRenamed("node", "rid"), "rid", "left")
    some = store.step(some.select("rid", "n", "bits", "text", F.coalesce("root", "rid").alias("comp")), "placed")
    rest = texts.withColumn("comp", F.col("rid"))

    def prefixes(kinds: str, wanted=None) -> DataFrame:
        return rest.mapInArrow(_prefixes(size, percent, order, wanted, special), kinds).unionByName(some.mapInArrow(_prefixes(size, percent, order, wanted), kinds))

    held = prefixes("key long, comp long")
    mixed_keys = store.step(held.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key"), "mixed")
    links = first_links
    if not mixed_keys.isEmpty():
        store.sweep()
        tiles = store.step(prefixes("key long, comp long, rid long, n int, bits array<long>, before array<long>, early boolean", spark.sparkContext.broadcast(_bit_filter(mixed_keys))), "tiles")
        store.drop(some)
        store.sweep()

        def band(n: Column) -> Column:
            return F.floor(F.log(n) / float(BAND_POWER * np.log(100 / percent)) + 1e-9).cast("int")

        # A set meets partners of at least percent / 100 of its size: those of its own band and, near the edge, of the one below.
        here, below = band(F.col("n")), band(F.col("n") * (percent / 100) - 1e-6)
        entries = tiles.withColumn("tile", F.explode(F.array_distinct(F.array(here, below)))).withColumn("smaller", F.col("early") & (F.col("tile") == here))
        crowds = entries.groupBy("key", "tile").agg(F.count("*").alias("held"), F.max("n").alias("largest")).where(F.col("held") > CROWD)
        crowds = store.step(crowds, "crowds")
        few = entries.join(crowds, ["key", "tile"], "left_anti")

        def sided(rows: DataFrame, side: str) -> DataFrame:
            return rows.select("key", "tile", F.col("comp").alias(f"c{side}"), F.col("rid").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"{side}_bits"), F.col("before").alias(f"{side}_before"))

        ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
        pairs = sided(few.where("smaller"), "a").join(sided(few, "b"), ["key", "tile"]).where((F.col("ca") != F.col("cb")) & ordered & _close_enough(percent) & ~F.arrays_overlap("a_before", "b_before"))
        pairs = store.step(pairs.select("a", "b").distinct(), "tile-pairs")
        celled = _crowded(entries, crowds).repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_members(percent), "cell long, side int, rid long, comp long")
        celled = store.step(celled, "cell-members")
        store.drop(tiles)
        store.sweep()
        met = celled.join(_inside(full.select("rid", "text"), _members(celled.select("rid").distinct())), "rid")
        within = store.step(met.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links(size, percent), "a long, b long"), "cell-links")
        likely = store.step(_likely(pairs, full, size, percent), "likely-pairs")
        links = store.step(_verified(likely, full, size, percent), "tile-links").unionByName(within).unionByName(first_links)
    root = components(links, store) if links is not first_links else first
    grouped = member.join(root.withColumnRenamed("node", "head"), "head", "left").select("rid", "doc_id", "n", "class_size", F.coalesce("root", "head").alias("root"))
    grouped = store.step(grouped, "grouped")
    store.keep_only(grouped, made)
    return grouped, everyone


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, name: str = "jaccard-join") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_size (documents of an equal set).

    Sets of distinct shingles of size words (all words as one where there are fewer) link when their Jaccard similarity is at
    least percent / 100. A null or empty text has no shingles and links with nothing: its component is its own doc_id.
    component_id is the smallest doc_id that links reach; rows of a null doc_id take part and have a null component only when all
    they reach are null. Repeated rows link with each other. A text of any length is one set; a worker holds the hashes of one text
    and of about a million bytes of others. An empty table gives no rows; other columns are ignored.
    """
    store = Scratch(documents.sparkSession, name)
    grouped, _ = _classified(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size, percent, store)
    least = store.step(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    store.keep_only(grouped, least)
    return grouped.join(least, "root").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "class_size")


def drop_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, name: str = "jaccard-join") -> DataFrame:
    """The rows of documents that stand for their component, with all columns: one row of each.

    It is the row of the smallest doc_id, of equal ones the first read; a null doc_id stands only where a component has no other.
    Rows without shingles stay, each on its own. Columns of any name pass through unchanged. An empty table gives no rows.
    """
    store = Scratch(documents.sparkSession, name)
    rows = packed_rows(documents, F.col("doc_id").cast("long").alias("doc_id"))
    grouped, written = _classified(rows, size, percent, store)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    kept = grouped.groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.rid").alias("rid"))
    gone = store.step(grouped.select("rid").join(kept, "rid", "left_anti"), "gone")
    # Rows that are surely not among those aren't shuffled, whatever their number.
    some, rows = _members(gone), written.select("rid", "text", "row")
    stays = _inside(rows, some, False).unionByName(_inside(rows, some).join(gone, "rid", "left_anti"))
    return unpacked_rows(stays, documents.columns)
