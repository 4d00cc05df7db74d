"""Characters of a script, runs of them, and fixed-size chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code point ranges of the target script. Two published variants
# differ in the upper bound of the first range.
SCRIPT_RANGES_STATS = ((0x17000, 0x187F7), (0x18800, 0x18AFF), (0x18D00, 0x18D8F))
SCRIPT_RANGES_PRETRAIN = ((0x17000, 0x187FF), (0x18800, 0x18AFF), (0x18D00, 0x18D8F))

# Letters and digits of any script: the class used where the input is alphabetic text.
ALNUM_CLASS = r"[\p{L}\p{N}]"

MIN_CHUNK = 4
MAX_CHUNK = 128


def script_class(ranges=SCRIPT_RANGES_STATS) -> str:
    """A regex character class for code point ranges."""
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]"


def in_script(ch: Column, char_class: str) -> Column:
    """True when the single character ``ch`` belongs to the class."""
    return ch.rlike(f"^{char_class}$")


def script_runs(text: Column, char_class: str) -> Column:
    """Maximal runs of in-class characters; everything else separates."""
    return F.regexp_extract_all(text, F.lit(f"({char_class}+)"), F.lit(1))


def characters(text: Column) -> Column:
    """Array of the characters (code points) of a string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def chunk_runs(runs: DataFrame, run_col: str, max_len: int = MAX_CHUNK, min_len: int = MIN_CHUNK) -> DataFrame:
    """Cut runs into consecutive pieces of ``max_len``; drop runs and pieces below ``min_len``.

    Adds ``piece`` (0-based) and ``chunk``; the other columns are kept.
    """
    keep = [c for c in runs.columns if c != run_col]
    pieces = (
        runs.where(F.length(run_col) >= min_len)
        .select(*keep, run_col,
                F.posexplode(F.sequence(F.lit(0), F.length(run_col) - 1, F.lit(max_len))).alias("piece", "_from"))
        .select(*keep, F.col("piece").cast("int").alias("piece"),
                F.substring(F.col(run_col), F.col("_from") + 1, F.lit(max_len)).alias("chunk"))
    )
    return pieces.where(F.length("chunk") >= min_len)


def length_bin(length: Column) -> Column:
    """Word length bin: 2 (and below), 3, 4, 5P."""
    return F.when(length <= 2, "2").when(length == 3, "3").when(length == 4, "4").otherwise("5P")
