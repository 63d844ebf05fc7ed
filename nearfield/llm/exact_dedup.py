"""Exact duplicates by distributed most-significant-digit radix partitioning.

A digit is a run of successive bytes of the normalised text: 32 bytes first, then runs that end at 256, 2,048, 16,384 ... bytes.
Every round splits the groups that still hold several documents by their next digit; a group of one document is done, and so are
the documents of a group whose text ends within the digit: they are equal byte by byte, without any digest. Digits are columns of
one table, so a round reads its own bytes only. A group is counted by partial aggregation and found again by an equi-join whose
large partitions Spark can split, so no task gathers a group of copies. All joins of digits are sort-merge joins, whatever the number
of copies: what is shuffled stays in proportion to the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch, packed_rows, unpacked_rows

#: Ends of the digits in bytes; the last is beyond the longest string that Spark holds.
ENDS = [32 * 8**k for k in range(9)] + [1 << 31]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _decided(table: DataFrame, store: Scratch) -> DataFrame:
    """(rid, keep_id, group_size, kept) of every row of (rid, doc_id, d0, d1, ...) that shares its text with another."""
    ended: list[DataFrame] = []
    open_ = table.select("rid", F.lit(0).cast("long").alias("node"), F.col("d0").alias("digit"))
    for i, (low, high) in enumerate(zip([0, *ENDS], ENDS, strict=False)):
        if i:
            open_ = open_.hint("merge").join(table.select("rid", F.col(f"d{i}").alias("digit")), "rid")
        groups = open_.groupBy("node", "digit").agg(F.min("rid").alias("next"), F.count("*").alias("n")).where("n > 1")
        groups = store.step(groups, f"groups{i}")  # a plain table, so that the join can split a large group
        found = open_.join(groups.hint("merge"), ["node", "digit"]).select("rid", F.col("next").alias("node"), (F.length("digit") < high - low).alias("end"))
        found = store.step(found, f"round{i}")
        ended.append(found.where("end").select("rid", F.col("node").alias("group")))
        open_ = found.where("not end").select("rid", "node")
        if open_.isEmpty():
            break
    members = store.step(reduce(DataFrame.unionByName, ended).join(table.select("rid", "doc_id"), "rid"), "members")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    groups = store.step(members.groupBy("group").agg(F.min(first).alias("first"), F.count("*").alias("size")), "groups")
    decided = members.join(groups, "group").select("rid", F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("first.rid") == F.col("rid")).alias("kept"))
    return store.step(decided, "decided")


def _digits(text: Column) -> list[Column]:
    return [F.substring(text, low + 1, high - low).alias(f"d{i}") for i, (low, high) in enumerate(zip([0, *ENDS], ENDS, strict=False))]


def exact_duplicates(documents: DataFrame, name: str = "exact-dedup") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row of the smallest doc_id stays; a null doc_id loses to any other (keep_id is
    null when all are null); of rows that also share the doc_id the first read stays. A text of any length is split into its
    digits; no step holds more than one row's. An empty table gives no rows; other columns are ignored.
    """
    store = Scratch(documents.sparkSession, name)
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"))
    whole = text.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.sha2("t", 256).alias("text_sha256"), F.col("t").cast("binary").alias("b"))
    table = store.step(whole.select("doc_id", "rid", "text_sha256", *_digits(F.col("b"))), "digits")
    decided = _decided(table, store)
    store.keep_only(decided, table)
    return table.select("rid", "doc_id", "text_sha256").join(decided, "rid", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(documents: DataFrame, name: str = "exact-dedup") -> DataFrame:
    """The rows of documents that stay, with all their columns unchanged; see exact_duplicates for which they are.

    Rows are followed by their own number from the radix rounds to the result; no digest takes part.
    """
    store = Scratch(documents.sparkSession, name)
    rows = store.step(packed_rows(documents, F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid")), "rows")
    whole = rows.select("rid", "doc_id", normalised(F.col("text")).cast("binary").alias("b"))
    decided = _decided(store.step(whole.select("rid", "doc_id", *_digits(F.col("b"))), "digits"), store)
    gone = store.step(decided.where("not kept").select("rid"), "gone")
    store.keep_only(rows, gone)
    return unpacked_rows(rows.join(gone, "rid", "left_anti"), documents.columns)
