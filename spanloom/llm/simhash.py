"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints within two bits agree on one of three bit blocks. So there are three tries, each with another
block in front, and in front no error is allowed: each trie falls apart into the subtrees below its block,
which Spark deals out. Within a subtree pairs of nodes are traversed together, the bits in which they differ
are added up, and a pair is pruned as soon as the budget is exceeded. A subtree with very many fingerprints
is cut again: what remains of its bits is split into three blocks by the same argument.

Only distinct fingerprints are joined, so copies cost nothing; a subtree hands on a spanning forest of its
links, which keeps every connection and never grows with the square of a group.
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

BITS, SEED, WORDS, BUDGET = 64, 42, 3, 2
#: Subtrees with more distinct fingerprints are cut again (changes the plan, not the result).
SUBTREE = 2048
#: Node pairs held at once in one traversal, about: squares of subtree sizes are added up to this.
FRONTIER = 1 << 21
SHINGLES = 1 << 17


def fingerprint(text: str | None) -> int:
    """SimHash of a text: bit set if set in over half of its shingles' hashes; zero without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    set_in = np.zeros(BITS, np.int64)
    for k in range(0, n, SHINGLES):
        part = words[k:k + SHINGLES + WORDS - 1]
        joined = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) >= WORDS else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], ">u8")
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number; one row per row of ``docs``, with its number ``row`` if there is one."""
    kept = ["row"] if row else []

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "fp": fp, **{c: batch[c].array for c in kept}})

    number = [docs[row].alias("row")] if row else []
    source = docs.select(docs[id_col].cast("bigint").cast("string").alias("doc_id"), docs[text_col].alias("text"), *number)
    return exact_id(source.mapInPandas(run, "doc_id string, fp bigint" + ", row bigint" * bool(row)))


def split_mask(mask: int) -> list[int]:
    """``mask`` (bits that must agree) joined with each third of the other bits."""
    free = [b for b in range(BITS - 1, -1, -1) if not mask >> b & 1]
    cuts = [round(i * len(free) / (BUDGET + 1)) for i in range(BUDGET + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def subtrees(values: DataFrame, limit: int = SUBTREE) -> DataFrame:
    """(fp, mask): the subtrees of all tries, as members; key is fp & mask. Those over ``limit`` are cut again."""
    masks = split_mask(0)
    rows = values.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    done = []
    for _ in range(3):
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        large = as_table(keyed.groupBy("mask", "key").count().where(F.col("count") > limit).drop("count"), "simhash-large")
        if large.isEmpty():
            break
        done.append(keyed.join(large, ["mask", "key"], "left_anti").select("fp", "mask"))
        below = {m: split_mask(m) for m in masks}
        children = F.create_map(*[x for m, c in below.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in c]))])
        rows = keyed.join(large, ["mask", "key"], "left_semi").select("fp", F.explode(children[F.col("mask")]).alias("mask"))
        masks = sorted({y for c in below.values() for y in c})
    for part in done:
        rows = rows.unionAll(part)
    return rows


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_pairs(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, mask: int, budget: int = BUDGET):
    """Index pairs within ``budget`` bits inside each range, by a joint traversal of trie nodes.

    ``values`` (unsigned, distinct within a range) are sorted inside each range and agree there on ``mask``.
    A node is a range of the sorted values, split where the current bit turns from 0 to 1.
    """
    lo_a = lo_b = starts
    hi_a = hi_b = stops
    diff = np.zeros(len(starts), np.int64)
    found = []
    for bit in range(BITS - 1, -1, -1):
        if mask >> bit & 1:
            continue
        ones = np.r_[0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]
        cut = lambda lo, hi: hi - (ones[hi] - ones[lo])
        mid_a, mid_b, same = cut(lo_a, hi_a), cut(lo_b, hi_b), lo_a == lo_b
        other = ~same
        parts = [(lo_a, mid_a, lo_b, mid_b, diff), (mid_a, hi_a, mid_b, hi_b, diff), (lo_a, mid_a, mid_b, hi_b, diff + 1),
                 (mid_a[other], hi_a[other], lo_b[other], mid_b[other], diff[other] + 1)]
        lo_a, hi_a, lo_b, hi_b, diff = (np.concatenate(x) for x in zip(*parts))
        size_a, size_b = hi_a - lo_a, hi_b - lo_b
        keep = (size_a > 0) & (size_b > 0) & (diff <= budget) & ((lo_a != lo_b) | (size_a > 1))
        leaf = keep & (size_a == 1) & (size_b == 1)
        if leaf.any():
            a, b = lo_a[leaf], lo_b[leaf]
            near = _popcount(values[a] ^ values[b]) <= budget
            found.append(np.stack([a[near], b[near]]))
        keep &= ~leaf
        lo_a, hi_a, lo_b, hi_b, diff = lo_a[keep], hi_a[keep], lo_b[keep], hi_b[keep], diff[keep]
        if not len(lo_a):
            break
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item it is connected to."""
    a, b = pairs
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(fp: np.ndarray, mask: np.ndarray) -> pd.DataFrame:
    """Spanning forests of whole subtrees: pairs (a, b) of fingerprints."""
    out = []
    for m in np.unique(mask):
        v = fp[mask == m].view(np.uint64)
        key = v & np.uint64(int(m) & (2**64 - 1))
        order = np.lexsort((v, key))
        v, key = v[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(new)
        stops = np.r_[starts[1:], len(v)]
        several = stops - starts > 1
        pairs = trie_pairs(v, starts[several], stops[several], int(m) & (2**64 - 1))
        label = forest(len(v), pairs)
        moved = label != np.arange(len(v))
        out.append(pd.DataFrame({"a": v[moved].view(np.int64), "b": v[label[moved]].view(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def _join_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (fp, mask, key) come sorted by subtree; whole subtrees are joined, several at a time."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        m, k = batch["mask"].to_numpy(), batch["key"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (k[1:] != k[:-1])])
        sizes = np.diff(np.r_[starts, len(batch)])
        # the last subtree may go on in the next batch
        block = np.cumsum(np.square(sizes[:-1])) // FRONTIER
        for g in np.unique(block):
            own = np.flatnonzero(block == g)
            lo, hi = starts[own[0]], starts[own[-1] + 1]
            yield _links(batch["fp"].to_numpy()[lo:hi], m[lo:hi])
        rest = batch.iloc[starts[-1]:] if len(starts) else None
    if rest is not None and len(rest):
        yield _links(rest["fp"].to_numpy(), rest["mask"].to_numpy())


def links(values: DataFrame, limit: int = SUBTREE) -> DataFrame:
    """(a, b): links between distinct fingerprints at up to two bits, reduced to forests per subtree."""
    rows = subtrees(values, limit).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    return (rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
            .mapInPandas(_join_sorted, "a bigint, b bigint"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SUBTREE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in at most two bits; component_id is the smallest doc_id
    reachable. Null and empty texts have no words: fingerprint zero, linked like any other. Rows with a null
    id keep it and take part; a component of such rows only has a null component_id. Repeated rows give
    repeated results; further columns are ignored; texts of any length are used whole; an empty table gives
    an empty result.
    """
    marked = as_table(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    values = as_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-values")
    label = components(links(values, limit), "simhash")
    labelled = values.join(label, values.fp == label.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    labelled = as_table(labelled, "simhash-labels")
    # both are written, so that each join has its own shuffles and AQE can split a hot label or fingerprint
    smallest = as_table(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "simhash-smallest")
    of_value = as_table(labelled.join(smallest, "label").select("fp", "component_id"), "simhash-components")
    return marked.join(of_value, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SUBTREE) -> DataFrame:
    """``docs`` with one row of each group of rows linked by their fingerprints, that with the smallest id; null ids come last.

    Rows are dropped by a number given once, so repeated rows and null ids are safe. Texts without words, whose fingerprint says
    nothing of them, link as in ``simhash_groups``. An empty table gives an empty result.
    """
    rows, row = numbered(docs, "simhash-rows")
    marked = as_table(fingerprints(rows, id_col, text_col, row), "simhash-fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    values = as_table(marked.groupBy("fp").agg(F.min(place).alias("at")), "simhash-values")
    label = components(links(values, limit), "simhash")
    labelled = values.join(label, values.fp == label.node, "left").select("at", F.coalesce("label", "fp").alias("label"))
    kept = labelled.groupBy("label").agg(F.min("at").alias("at")).select(F.col("at.row").alias(row))
    return by_number(rows, kept, row, "left_semi", "simhash-kept").select(*docs.columns)
