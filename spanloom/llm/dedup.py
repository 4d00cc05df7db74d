"""Exact deduplication with two-pass Bloom filtering, in DataFrame functions only.

Pass one counts how many rows fall on each slot of a Bloom filter with ``hashes`` slots per row; slots hit
at least twice become the bits of a second filter. Pass two tests every row against that filter: a row with
an unset slot is certainly unique and passes straight through, without any shuffle. Only the rest, the
copies and a few false positives, is shuffled by its hash, and only as (id, hash), never with its text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SPACES, by_number, numbered
from spanloom.session import as_table

BITMAP_BITS = 32768
#: Bounds of the filter: 128 kB to 32 MB. A full filter costs extra shuffled rows, never a wrong result.
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
BITS_PER_ROW = 16


def text_key(text: Column) -> Column:
    """SHA-256 (hex) of the text with every run of white space as one blank; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256)


def filter_bits(rows: int) -> int:
    """Power of two with ``BITS_PER_ROW`` bits a row, within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(max(1, rows) * BITS_PER_ROW))))


def _slot(sha: Column, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(bits))


def repeated_slots(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Pass one: the filter of slots hit twice or more, as (bucket, bitmap) of 4 kB bitmaps.

    Counting combines on the map side, so a text that fills a third of the table is one slot a task.
    """
    slots = keys.select(F.explode(F.array(*[_slot(F.col("sha"), i, bits) for i in range(hashes)])).alias("slot"))
    twice = slots.groupBy("slot").count().where("count > 1").select(
        F.floor(F.col("slot") / BITMAP_BITS).alias("bucket"), (F.col("slot") % BITMAP_BITS).alias("bit"))
    return (twice.repartition("bucket").groupBy("bucket")
            .agg(F.bitmap_construct_agg("bit").alias("bitmap")))


def _is_set(bitmap: Column, slot: Column) -> Column:
    bit = slot % BITMAP_BITS
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def possibly_repeated(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Pass two: ``keys`` with a flag ``maybe``; rows whose hash occurs twice always have it."""
    bitmaps = repeated_slots(keys, bits, hashes)
    out = keys.withColumn("maybe", F.lit(True))
    for i in range(hashes):
        slot = _slot(F.col("sha"), i, bits)
        # at most bits / 32768 rows of 4 kB: bounded by MAX_BITS, whatever the input
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_b{i}"), F.col("bitmap").alias(f"_m{i}")))
        out = out.withColumn(f"_s{i}", slot).join(side, F.floor(F.col(f"_s{i}") / BITMAP_BITS) == F.col(f"_b{i}"), "left")
        out = out.withColumn("maybe", F.col("maybe") & _is_set(F.col(f"_m{i}"), F.col(f"_s{i}"))).drop(f"_s{i}", f"_b{i}", f"_m{i}")
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised text the one with the smallest id stays; null ids come last. Rows
    repeated with the same id and text count each, and one of them stays. Null and empty texts are equal to
    each other. Texts of any length are hashed whole; further columns are ignored; an empty table gives an
    empty result.
    """
    keys = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_key(docs[text_col]).alias("sha"),
                       F.monotonically_increasing_id().alias("rid"))
    return _grouped(as_table(keys, "exact-keys"), hashes).drop("rid")


def _grouped(keys: DataFrame, hashes: int) -> DataFrame:
    """The groups of written (doc_id, sha, rid), with rid."""
    marked = as_table(possibly_repeated(keys, filter_bits(keys.count()), hashes), "exact-marked")
    maybe = marked.where("maybe")
    groups = maybe.groupBy("sha").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    # written, so that the join has a shuffle of its own on both sides, which AQE can split for a hot text
    copies = maybe.join(as_table(groups, "exact-groups"), "sha").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"), "rid")
    alone = marked.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"), "rid")
    return alone.unionAll(copies)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: int = 2) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops: of equal texts one row stays, whatever the ids.

    Rows are dropped by a number given once, so repeated rows, different texts of one id and null ids are safe.
    """
    rows, row = numbered(docs, "exact-rows")
    keys = rows.select(rows[id_col].cast("bigint").alias("doc_id"), text_key(rows[text_col]).alias("sha"), rows[row].alias("rid"))
    dropped = _grouped(as_table(keys, "exact-keys"), hashes).where("not kept").select(F.col("rid").alias(row))
    return by_number(rows, dropped, row, "left_anti", "exact-dropped").select(*docs.columns)
