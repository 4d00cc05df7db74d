"""Building blocks that keep plans safe on skewed and large data.

* ``keyed_join`` broadcasts a lookup table only when its size is known to be small
  and otherwise salts the join, so that one hot key is spread over many tasks.
* ``lookup_join`` does the same for tables that grow with the data, without copies of them: a filter lets rows
  without a partner go, hot keys meet a broadcast of their own, and the rest is shuffled once.
* ``exact_rank`` numbers rows in hash order without a single-task global sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import as_table

BROADCAST_BYTES = 128 * 1024 * 1024
ROW_OVERHEAD = 48
HASH_FACTOR = 2
SALTS = 32
#: Slots of the filter over a lookup table's keys: per key, and at most (32 MB); bits in one bitmap of it.
FILTER_BITS, MAX_FILTER_BITS, BITMAP_BITS = 8, 1 << 28, 32768
#: A key is hot with more than one in so many rows.
HOT_SHARE = 512
BUCKET_ROWS = 1 << 20


def value_bytes(col: Column, kind: T.DataType) -> Column:
    """Upper estimate of the size of one value, through arrays, structs and maps; a null counts as empty."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(col) + 24
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(col, F.lit(24).cast("bigint"), lambda acc, x: acc + value_bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = value_bytes(F.map_keys(col), T.ArrayType(kind.keyType)) + value_bytes(
            F.map_values(col), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = F.lit(16)
        for f in kind.fields:
            size = size + value_bytes(col.getField(f.name), f.dataType)
    else:
        size = F.lit(16)
    return F.coalesce(size.cast("bigint"), F.lit(24).cast("bigint"))


def table_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size of ``df``: one distributed aggregate, one row back."""
    per_row: Column = F.lit(ROW_OVERHEAD)
    for field in df.schema.fields:
        per_row = per_row + value_bytes(F.col(f"`{field.name}`"), field.dataType)
    total = df.agg(F.sum(per_row.cast("bigint")).alias("b")).first()["b"]
    return int(total or 0)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the hash table of a broadcast of ``df`` stays below ``limit``."""
    return table_bytes(df) * HASH_FACTOR <= limit


def keyed_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str, *, small_fits: bool,
               spread: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Join ``big`` to a lookup table with one row per key.

    ``small_fits`` is the outcome of a size check. When it is false both sides are
    shuffled on (key, salt): a row of ``big`` takes its salt from the ``spread`` columns,
    the lookup table is repeated once per salt, so a key holding a third of all rows is
    divided among ``salts`` tasks and every row still finds its match.
    """
    on = list(on)
    if small_fits:
        return big.join(F.broadcast(small), on, how)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_big.join(salted_small, on + ["_salt"], how).drop("_salt")


def key_slot(on: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(bits))


def key_filter(small: DataFrame, on: Sequence[str], bits: int) -> DataFrame:
    """The keys of ``small`` as a bit set of ``bits`` slots: (bucket, bitmap), 4 kB a bitmap."""
    slots = small.select(key_slot(on, bits).alias("slot")).distinct().select(
        F.floor(F.col("slot") / BITMAP_BITS).alias("_bucket"), (F.col("slot") % BITMAP_BITS).alias("bit"))
    return slots.groupBy("_bucket").agg(F.bitmap_construct_agg("bit").alias("_bitmap"))


def split_by_filter(big: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """``big`` with ``_maybe``: false only where the key is certainly not in ``small``, as for keys with a null.

    One hash a key and ``FILTER_BITS`` bits a row, 32 MB at most; a fuller filter lets more rows through.
    """
    rows = max(1, small.count())
    bits = min(MAX_FILTER_BITS, max(BITMAP_BITS, 1 << math.ceil(math.log2(rows * FILTER_BITS))))
    slot = big.withColumn("_slot", key_slot(on, bits))
    # at most MAX_FILTER_BITS / 32768 bitmaps of 4 kB, whatever the input
    met = slot.join(F.broadcast(key_filter(small, on, bits)), F.floor(F.col("_slot") / BITMAP_BITS) == F.col("_bucket"), "left")
    bit = F.col("_slot") % BITMAP_BITS
    byte = F.conv(F.hex(F.substring("_bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    maybe = known & F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return met.withColumn("_maybe", maybe).drop("_slot", "_bucket", "_bitmap")


def hot_keys(rows: DataFrame, on: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """The keys with more than one in ``share`` of all rows: fewer than ``share`` of them, however large the table."""
    total = rows.count()
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * share > F.lit(total)).drop("_n")


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str, *, small_fits: bool, share: int = HOT_SHARE) -> DataFrame:
    """Join ``big`` (inner or left) to a lookup table with one row per key.

    ``small_fits`` is the outcome of a size check: then ``small`` is broadcast. Else rows of ``big`` whose key
    is not in a bit set of the keys of ``small`` leave before any shuffle. The rest is written, and split: keys with more than one in
    ``share`` of its rows meet a broadcast of their few lookup rows, all others one plain shuffle of both sides.
    So ``small`` is moved once, and no task holds more than a hash partition of the rarer keys.
    """
    on = list(on)
    if small_fits:
        return big.join(F.broadcast(small), on, how)
    if how not in ("inner", "left"):
        raise ValueError(f"unknown kind of join {how!r}")
    cut = split_by_filter(big, small, on)
    if how == "left":
        cut = as_table(cut, "keyed-rows")
        rows, rest = cut.where("_maybe").drop("_maybe"), cut.where("not _maybe").drop("_maybe")
    else:
        rows, rest = as_table(cut.where("_maybe").drop("_maybe"), "keyed-rows"), None
    hot = as_table(small.join(F.broadcast(hot_keys(rows, on, share)), on, "left_semi"), "keyed-hot")
    if fits_broadcast(hot):
        flag = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
        flagged = rows.join(flag, on, "left")
        often = flagged.where("_hot").drop("_hot").join(F.broadcast(hot), on, "inner")
        out = flagged.where("_hot is null").drop("_hot").join(small.hint("shuffle_merge"), on, how).unionByName(often)
    else:  # few keys with huge values: AQE divides their partitions
        out = rows.join(small.hint("shuffle_merge"), on, how)
    if rest is None:
        return out
    names = [f for f in small.schema.fields if f.name not in on]
    return out.unionByName(rest.withColumns({f.name: F.lit(None).cast(f.dataType) for f in names}))


def seeded_hash(seed: int | str, *cols: Column | str) -> Column:
    """md5 over ``seed`` and the columns: the only source of pseudo-randomness here."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def hash_int(digest: Column) -> Column:
    """The first 8 hex digits of a digest as BIGINT in [0, 2^32)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_unit(digest: Column) -> Column:
    """The first 8 hex digits of a digest as a double in [0, 1)."""
    return hash_int(digest) / F.lit(4294967296.0)


def rank_digits(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """Hex digits that cut ``rows`` into buckets of at most about ``per_bucket``; three at least."""
    digits = 3
    while rows > per_bucket * 16 ** digits:
        digits += 1
    return digits


def exact_rank(df: DataFrame, digest: str, tie: str, by: Sequence[str] = (), digits: int | None = None,
               rank: str = "rank", total: str = "n") -> DataFrame:
    """Add the 0-based rank of each row in (digest, tie) order per ``by``, and the group size.

    A window over a whole group would sort it in one task. The digest is uniform, so its
    leading hex digits cut every group into 16^digits even, already ordered buckets: the
    bucket sizes (a small table) give each bucket its offset and ``row_number`` runs
    inside a bucket only. Join and window share the (by, bucket) partitioning.
    ``digits`` follows from the number of rows, so that a bucket stays near a million rows.
    """
    by = list(by)
    digits = digits or rank_digits(df.count())
    cut = df.withColumn("_bucket", F.substring(digest, 1, digits))
    sizes = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sizes.select(
        *by, "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(whole).alias(total),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(digest, tie)
    return (
        cut.join(offsets, by + ["_bucket"])
        .withColumn(rank, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
