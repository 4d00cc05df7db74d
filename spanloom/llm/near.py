"""Near deduplication by similarity: five-word shingles, Jaccard 0.8 or more.

Several fingerprints per text find the candidates: minima of 64 hash functions over its shingles, in 16 bands of four.
Texts that are alike share a band with probability 1 - (1 - J^4)^16, 0.9998 at J = 0.8. In each band's bucket every
text is paired with the first and with the last one, so pairs grow with the number of texts and not with its square.
The shingles of each pair are then compared in full: a link is certain, only candidates are left to chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import by_number, components, exact_id, numbered
from spanloom.session import as_table

WORDS, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 16, 4, 42
#: Shingles hashed at once by all functions.
CHUNK = 1 << 13
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_RNG = np.random.default_rng(SEED)
_XOR, _TIMES = (_RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; all words if there are fewer, none without words."""
    w = np.array([xxhash.xxh64_intdigest(x, SEED) for x in (text or "").encode().lower().split()], np.uint64)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mixed(h * _PRIME + w[k:len(w) - n + 1 + k])
    return np.unique(h)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles; two empty ones are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def bands(h: np.ndarray) -> np.ndarray:
    """A key per band, as signed numbers, from the minima of all hash functions."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(h), CHUNK):
        low = np.minimum(low, ((h[None, k:k + CHUNK] ^ _XOR) * _TIMES).min(1))
    key = np.zeros(BANDS, np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = _mixed(key * _PRIME + part)
    return key.view(np.int64)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = []
        keys = []
        for text in batch["text"]:
            h = shingles(text)
            sets.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
            keys.append(bands(h))
        yield pd.DataFrame({"row": batch["row"].array, "doc_id": batch["doc_id"].array, "set": sets, "bands": keys})


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) whose texts are alike; a text that comes several times on end is cut once."""
    last, of_last = None, np.zeros(0, np.uint64)
    for batch in batches:
        out = []
        for a, b, x, y in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
            if b != last:
                last, of_last = b, shingles(y)
            if similarity(shingles(x), of_last) >= SIMILARITY:
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def candidates(values: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of rows that share a bucket, one of them its first or last row by id."""
    place = F.struct("no_id", "doc_id", "row").alias("place")
    buckets = as_table(values.select("row", place, F.posexplode("bands").alias("band", "key")), "near-buckets")
    # written, so that the join has its own shuffles and AQE can split a hot bucket
    ends = as_table(buckets.groupBy("band", "key").agg(F.min("place").alias("first"), F.max("place").alias("last"))
                    .where("first <> last").select("band", "key", F.col("first.row").alias("first"), F.col("last.row").alias("last")), "near-ends")
    met = buckets.select("band", "key", "row").join(ends, ["band", "key"])
    both = met.select("row", F.explode(F.array("first", "last")).alias("end")).where("row <> end")
    return as_table(both.select(F.least("row", "end").alias("a"), F.greatest("row", "end").alias("b")).distinct(), "near-candidates")


def near_rows(rows: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    """(row): the numbers of the rows to drop."""
    source = rows.select(rows[row].alias("row"), rows[id_col].cast("bigint").cast("string").alias("doc_id"), rows[text_col].alias("text"))
    marked = exact_id(source.mapInPandas(_signatures, "row bigint, doc_id string, set string, bands array<bigint>"))
    marked = as_table(marked.withColumn("no_id", F.col("doc_id").isNull()), "near-marked")
    # equal sets of shingles count once
    values = as_table(marked.groupBy("set").agg(F.min(F.struct("no_id", "doc_id", "row", "bands")).alias("v")).select("v.*"), "near-values")
    pairs = candidates(values)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    texts = as_table(by_number(source.select("row", "text"), needed, "row", "left_semi", "near-needed"), "near-texts")
    side = lambda end: texts.select(F.col("row").alias(end), F.col("text").alias(f"text_{end}"))
    linked = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInPandas(_alike, "a bigint, b bigint")
    label = as_table(components(linked, "near"), "near-labels")
    labelled = as_table(values.select("no_id", "doc_id", "row").join(label, F.col("row") == F.col("node")), "near-labelled")
    kept = labelled.groupBy("label").agg(F.min(F.struct("no_id", "doc_id", "row")).alias("v")).select("v.row")
    copies = marked.select("row").join(values.select("row"), "row", "left_anti")
    return copies.unionAll(labelled.select("row").join(kept, "row", "left_anti"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of rows linked by similar texts, that with the smallest id; null ids come last.

    Texts with equal sets of shingles are alike, also those without words. Rows are dropped by a number given once,
    so repeated rows, different texts of one id and null ids are safe. An empty table gives an empty result.
    """
    rows, row = numbered(docs, "near-rows")
    dropped = near_rows(rows, row, id_col, text_col).select(F.col("row").alias(row))
    return by_number(rows, dropped, row, "left_anti", "near-dropped").select(*docs.columns)
