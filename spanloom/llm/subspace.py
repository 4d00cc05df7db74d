"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with a cosine of at least t are at most r = sqrt(2 (1 - t)) apart. After a fixed random rotation they are
split into blocks of about eight dimensions: if every block of a pair differed by more than its share of r^2 (in
proportion to its dimensions), the pair would be too far apart. So a range join in each block, each with its budget,
finds every link, and the union of the blocks' candidates is verified.

Rows travel as one byte per dimension, with the exact rounding error of the vector beside them. Distances between codes
are whole numbers, so each block's test comes out the same wherever it is made: a pair is counted in the first block
that passes it, nothing has to be made distinct. Errors turn the code distance into bounds: pairs surely linked or surely
not are settled in place, the few in between are compared in full precision. Tasks hand on counts and spanning
forests, never the pairs of a dense group.

Units of work are a label's blocks. A label over ``LIMIT`` distinct vectors is cut into slabs along the block's leading
dimensions, a vector visiting the slabs within reach; what still holds more is dealt out in parts, each of which meets all
the slab's vectors.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import components, exact_id
from spanloom.llm.simhash import forest
from spanloom.plans.scale import fits_broadcast, keyed_join
from spanloom.session import as_table

SEED, BLOCK_DIMS, THRESHOLD = 42, 8, 0.93
#: Distinct vectors of a unit that others are compared with; more are cut or dealt out (changes the plan, not the result).
LIMIT = 1 << 14
#: Leading dimensions of a block along which it may be cut; a cut doubles the rows and leaves two fifths of them in a slab.
CUTS = 2
#: Codes reach four standard deviations of a coordinate; what is beyond counts as rounding error.
SPREAD, TOP = 4.0, 127
#: Pairs held at once: in a matrix of block distances, and with all their dimensions.
SLAB, PAIRS = 1 << 21, 1 << 16
MARGIN = 1e-9

UNIT = ["label", "dim", "block", "cell", "chunk"]
CODED = "key binary, label string, dim int, code binary, block_error double, error double, vector binary"


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """A random rotation (or reflection), the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bounds(dim: int) -> np.ndarray:
    """Where blocks start, and the end."""
    return np.round(np.linspace(0, dim, max(1, round(dim / BLOCK_DIMS)) + 1)).astype(int)


def step(dim: int) -> float:
    return SPREAD / np.sqrt(dim) / TOP


def budgets(dim: int, threshold: float) -> np.ndarray:
    """Per block the largest distance that its share allows, in steps of the codes."""
    return np.sqrt(2 * (1 - threshold) * np.diff(bounds(dim)) / dim) / step(dim) + MARGIN


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, largest error of a block in steps, error) of finite vectors that are not zero."""
    dim = vectors.shape[1]
    unit = vectors / np.abs(vectors).max(1, keepdims=True)
    unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
    turned = unit @ rotation(dim)
    code = np.clip(np.rint(turned / step(dim)), -TOP, TOP)
    off = np.square(turned / step(dim) - code)
    return code.astype(np.int8), np.sqrt(np.add.reduceat(off, bounds(dim)[:-1], axis=1).max(1)) + MARGIN, np.sqrt(off.sum(1)) * step(dim) + MARGIN


def _encode(batches):
    """Rows (vec_id, label, embedding) to their codes; without a key if the vector links with nothing."""
    for batch in batches:
        out = {name.split()[0]: [None] * len(batch) for name in CODED.split(", ")}
        sizes = batch["embedding"].map(lambda v: -1 if v is None else len(v)).to_numpy(np.int64)
        labels = batch["label"].tolist()
        for dim in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == dim)
            x = np.stack([np.asarray(batch["embedding"].iat[i], np.float64) for i in rows])
            good = np.isfinite(x).all(1) & (x != 0).any(1) & np.array([labels[i] is not None for i in rows])
            if good.any():
                x, rows = x[good], rows[good]
                for i, v, code, block_error, error in zip(rows, x, *coded(x)):
                    raw = v.tobytes()
                    own = (hashlib.md5(repr(labels[i]).encode() + raw).digest(), labels[i], int(dim), code.tobytes(), block_error, error, raw)
                    for name, value in zip(out, own):
                        out[name][i] = value
        yield pd.DataFrame({"vec_id": batch["vec_id"].array, **out})


def _cells(threshold: float, counting: bool):
    """Rows with (cuts, most) to one row per block and slab they belong to or visit; or to counts of those that belong."""

    def run(batches):
        for batch in batches:
            for dim in batch["dim"].unique():
                part = batch[batch["dim"] == dim]
                codes = np.frombuffer(b"".join(part["code"]), np.int8).reshape(-1, dim).astype(np.int64)
                cuts, reach = part["cuts"].to_numpy(), (part["block_error"] + part["most"]).to_numpy()
                starts, radius = bounds(dim), budgets(dim, threshold)
                for block, (lo, hi) in enumerate(zip(starts, starts[1:])):
                    row, cell, home = np.arange(len(part)), np.zeros(len(part), np.int64), np.ones(len(part), bool)
                    for k in range(min(CUTS, hi - lo)):
                        x, far, wide = codes[row, lo + k], radius[block] + reach[row], 2 * radius[block]
                        cut = cuts[row] > k
                        own, first, last = (np.where(cut, np.floor(v / wide), 0).astype(np.int64) for v in (x, x - far, x + far))
                        many = last - first + 1
                        again = np.repeat(np.arange(len(row)), many)
                        at = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many) + first[again]
                        row, cell, home = row[again], cell[again] << 16 | at + (1 << 15), home[again] & (at == own[again])
                    if counting:
                        yield (pd.DataFrame({"label": part["label"].array[row[home]], "dim": dim, "block": block, "cell": cell[home], "rows": 1})
                               .groupby(["label", "dim", "block", "cell"], as_index=False).sum())
                    else:
                        own = part.iloc[row]
                        yield pd.DataFrame({"label": own["label"].array, "dim": dim, "block": block, "cell": cell, "home": home, "at": codes[row, lo],
                                            "rep": own["rep"].array, "n": own["n"].array, "code": own["code"].array,
                                            "block_error": own["block_error"].array, "error": own["error"].array})
    return run


class _Side:
    """Vectors of one unit, ordered by their first coordinate in the block."""

    def __init__(self, rows: pd.DataFrame, dim: int, lo: int, hi: int):
        self.rep, self.n, self.at = (rows[c].to_numpy(np.int64) for c in ("rep", "n", "at"))
        self.code = np.frombuffer(b"".join(rows["code"]), np.int8).reshape(-1, dim)
        self.block = self.code[:, lo:hi].astype(np.float32)
        self.square = np.square(self.block).sum(1)
        self.block_error, self.error = rows["block_error"].to_numpy(), rows["error"].to_numpy()


class _Unit:
    """One block of a slab: its own rows, and the visitors that stream by."""

    def __init__(self, dim: int, block: int, threshold: float, own: pd.DataFrame):
        self.dim, self.number = dim, block
        self.starts = bounds(dim)
        self.radius, self.far, self.step = budgets(dim, threshold), np.sqrt(2 * (1 - threshold)), step(dim)
        self.lo, self.hi = self.starts[block], self.starts[block + 1]
        self.own = _Side(own, dim, self.lo, self.hi)
        self.root, self.links = np.arange(len(own)), np.zeros(len(own), np.int64)
        self.out = []
        each = max(1, SLAB // max(1, len(own)))
        for k in range(0, len(own), each):
            self.meet(_Side(own.iloc[k:k + each], dim, self.lo, self.hi), k)

    def visit(self, rows: pd.DataFrame) -> None:
        each = max(1, SLAB // max(1, len(self.root)))
        for k in range(0, len(rows) if len(self.root) else 0, each):
            self.meet(_Side(rows.iloc[k:k + each], self.dim, self.lo, self.hi), None)

    def meet(self, other: _Side, offset: int | None) -> None:
        """Compare all own rows with some others; ``offset`` is their place among the own rows, if they are such."""
        own, radius = self.own, self.radius[self.number]
        reach = radius + own.block_error.max() + other.block_error.max()
        lo, hi = np.searchsorted(own.at, other.at.min() - reach), np.searchsorted(own.at, other.at.max() + reach, "right")
        near = own.square[lo:hi, None] + other.square - 2 * (own.block[lo:hi] @ other.block.T)
        i, j = np.nonzero(near <= np.square(reach))
        i += lo
        linked = []
        for k in range(0, len(i), PAIRS):
            p, q = i[k:k + PAIRS], j[k:k + PAIRS]
            apart = np.square(own.code[p].astype(np.int32) - other.code[q])
            by_block = np.add.reduceat(apart, self.starts[:-1], axis=1)
            passes = by_block <= np.square(self.radius + (own.block_error[p] + other.block_error[q])[:, None])
            mine = passes[:, self.number] & ~passes[:, :self.number].any(1) & (own.rep[p] != other.rep[q])
            p, q = p[mine], q[mine]
            distance, slack = np.sqrt(by_block[mine].sum(1)) * self.step, own.error[p] + other.error[q]
            sure = distance + slack <= self.far - MARGIN
            open_ = ~sure & (distance - slack <= self.far + MARGIN) & (own.rep[p] < other.rep[q])
            self.out.append(pd.DataFrame({"a": own.rep[p[open_]], "b": other.rep[q[open_]], "links": 0, "sure": False}))
            np.add.at(self.links, p[sure], other.n[q[sure]])
            linked.append(np.stack([p[sure], q[sure]]))
        a, b = np.concatenate(linked, axis=1) if linked else np.zeros((2, 0), np.int64)
        if len(a):
            n = len(self.root)
            label = forest(n + len(other.rep), np.stack([self.root[a], n + b if offset is None else self.root[offset + b]]))
            self.root = label[self.root]
            if offset is None:
                seen = np.unique(b)
                self.out.append(pd.DataFrame({"a": other.rep[seen], "b": own.rep[label[n + seen]], "links": 0, "sure": True}))

    def results(self):
        """Rows (a, b, links, sure): links of a; edges of a forest; open pairs."""
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        self.out.append(pd.DataFrame({"a": self.own.rep[moved], "b": self.own.rep[self.root[moved]], "links": 0, "sure": True}))
        some = np.flatnonzero(self.links)
        yield pd.DataFrame({"a": self.own.rep[some], "b": self.own.rep[some], "links": self.links[some], "sure": True})
        yield from self.given()

    def given(self):
        out, self.out = [x for x in self.out if len(x)], []
        if out:
            yield pd.concat(out)


def _join(threshold: float):
    def run(batches):
        """Rows come by unit, its own rows first, then by their first coordinate."""
        unit, key, held = None, None, []
        for batch in batches:
            keys = list(zip(*(batch[c] for c in [*UNIT, "visits"])))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                rows = batch.iloc[s:e]
                if keys[s][:-1] != key:
                    unit = unit or (held and _Unit(key[1], key[2], threshold, pd.concat(held)))
                    if unit:
                        yield from unit.results()
                    unit, key, held = None, keys[s][:-1], []
                if not keys[s][-1]:
                    held.append(rows)
                else:
                    if unit is None and held:
                        unit = _Unit(key[1], key[2], threshold, pd.concat(held))
                    if unit:  # a slab may have visitors only
                        unit.visit(rows)
                        yield from unit.given()
        unit = unit or (held and _Unit(key[1], key[2], threshold, pd.concat(held)))
        if unit:
            yield from unit.results()
    return run


def _cosines(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"], batch["y"]):
            x, y = np.frombuffer(x), np.frombuffer(y)
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            keep.append(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)))
        yield batch.assign(cosine=np.array(keep, float)).drop(columns=["x", "y"])


def candidate_links(reps: DataFrame, threshold: float, limit: int) -> DataFrame:
    """(a, b, links, sure) from all units of the distinct vectors ``reps``."""
    stats = as_table(reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows"), F.max("block_error").alias("most")), "subspace-labels")
    cuts = F.when(F.col("rows") <= limit, 0).otherwise(F.least(F.lit(CUTS), F.ceil(F.log(F.col("rows") / limit) / F.log(F.lit(2.5))))).cast("int")
    stats = stats.select("label", "dim", "rows", "most", cuts.alias("cuts"))
    placed = keyed_join(reps.drop("vector", "first"), stats.drop("rows"), ["label", "dim"], "inner", small_fits=fits_broadcast(stats), spread=["rep"])
    cell = "label string, dim int, block int, cell bigint"
    units = placed.mapInPandas(_cells(threshold, False), f"{cell}, home boolean, at bigint, rep bigint, n bigint, code binary, block_error double, error double")
    units = units.withColumn("parts", F.lit(1))
    if not stats.where(F.col("rows") > limit).isEmpty():
        counted = placed.mapInPandas(_cells(threshold, True), f"{cell}, rows bigint").groupBy("label", "dim", "block", "cell").agg(F.sum("rows").alias("rows"))
        large = as_table(counted.where(F.col("rows") > limit).select("label", "dim", "block", "cell", F.ceil(F.col("rows") / limit).alias("many")), "subspace-large")
        units = keyed_join(units, large, ["label", "dim", "block", "cell"], "left", small_fits=fits_broadcast(large), spread=["rep"])
        units = units.withColumn("parts", F.coalesce("many", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("parts"))
    dealt = units.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))).withColumn(
        "visits", ~(F.col("home") & (F.col("chunk") == own)))
    return (dealt.select(*UNIT, "visits", "at", "rep", "n", "code", "block_error", "error").repartition(*UNIT)
            .sortWithinPartitions(*UNIT, "visits", "at").mapInPandas(_join(threshold), "a bigint, b bigint, links bigint, sure boolean"))


def similar_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Vectors of one label and dimension link if their cosine, in double precision, is at least ``threshold`` (over -1, under 1).
    n_links counts the other rows linked directly, component_id is the smallest id reachable (itself included), kept says
    whether that is its own. Rows without a label and vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing. Repeated rows link with each other like any equal vectors. Rows with a null id
    take part; a component of such rows only has a null component_id, and they are kept. Ties cannot occur; further
    columns are ignored; an empty table gives an empty one.
    """
    source = df.select(df[id_col].cast("bigint").cast("string").alias("vec_id"), df[label_col].cast("string").alias("label"),
                       df[vector_col].cast("array<double>").alias("embedding"))
    rows = as_table(exact_id(source.mapInPandas(_encode, f"vec_id string, {CODED}"), "vec_id"), "subspace-rows")
    one = [F.first(c).alias(c) for c in ("label", "dim", "code", "block_error", "error", "vector")]
    reps = rows.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), *one)
    reps = as_table(reps.withColumn("rep", F.monotonically_increasing_id()), "subspace-distinct")

    found = as_table(candidate_links(reps.drop("key"), threshold, limit), "subspace-found")
    at = lambda end, v: reps.select(F.col("rep").alias(end), F.col("n").alias(f"n{end}"), F.col("vector").alias(v))
    open_pairs = found.where("NOT sure").select("a", "b").join(at("a", "x"), "a").join(at("b", "y"), "b").select("a", "b", "na", "nb", "x", "y")
    exact = as_table(open_pairs.mapInPandas(_cosines, "a bigint, b bigint, na bigint, nb bigint, cosine double").where(F.col("cosine") >= threshold), "subspace-exact")

    counts = (found.where("links > 0").select(F.col("a").alias("rep"), "links")
              .unionAll(exact.select("a", "nb")).unionAll(exact.select("b", "na")).groupBy("rep").agg(F.sum("links").alias("links")))
    label = components(found.where("sure AND a <> b").select("a", "b").unionAll(exact.select("a", "b")), "subspace")
    labelled = as_table(reps.select("key", "rep", "n", "first").join(label, F.col("rep") == F.col("node"), "left").join(counts, "rep", "left").select(
        "key", "first", F.coalesce("label", "rep").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "subspace-labelled")
    smallest = as_table(labelled.groupBy("group").agg(F.min("first").alias("component_id")), "subspace-smallest")
    result = as_table(labelled.join(smallest, "group").select("key", "n_links", "component_id"), "subspace-result")
    joined = rows.select("vec_id", "key").join(result, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"),
                         F.col("vec_id").eqNullSafe(component).alias("kept"))
