"""Character vectors from unlabelled runs: skip-gram with hierarchical softmax on the counts of all pairs.

A step of skip-gram depends on its pair of characters only, and the alphabet is small, so the pairs of all runs are counted once, in
one pass of the tasks: a pair at distance d has the weight (window + 1 - d) / window, the chance that a window of random width
holds it. An epoch is then a job over these counts: a task holds some characters with all their pairs, starts from the common
vectors and moves them as far as that many single steps would, in ``SUBSTEPS`` steps; the vectors of the tree's nodes are
averaged over the tasks by their counts. So time grows with the runs in the counting only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.match import Text, steps
from spanloom.session import as_table

# Settings of the reference embedding.
VECTOR_SIZE, WINDOW, MIN_COUNT, EPOCHS, SEED = 192, 5, 1, 30, 42
#: Learning rate of a single step, falling to 0; steps of an epoch, and how far one may go whatever the counts.
RATE, SUBSTEPS, FARTHEST = 0.025, 100, 0.5
#: Characters of a task at least, and numbers of one block of counts.
TASK_CHARS, BLOCK_CELLS = 8, 1 << 21


def pair_counts(runs: DataFrame, run: str = "run", window: int = WINDOW) -> DataFrame:
    """(ch, by, n): how often two characters stand within the window in units of 1 / window, each in turn as ``ch``; ``by`` -1 counts
    the character itself. Of runs of two characters or more; counted within each batch first."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "run"):
            text = Text(batch["run"])
            codes, row = text.codes.astype(np.int64), text.rows()
            keys, weights = [codes << 22], [np.ones(text.n, np.int64)]
            for d in range(1, window + 1):
                at = np.flatnonzero(row[d:] == row[:-d])
                a, b = codes[at], codes[at + d]
                keys += [(a << 22) + b + 1, (b << 22) + a + 1]
                weights += [np.full(2 * len(at), window + 1 - d, np.int64)]
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(place, np.concatenate(weights), len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 22), pa.array((key & ((1 << 22) - 1)) - 1), pa.array(n)], ["ch", "by", "n"])

    rows = runs.where(F.length(run) >= 2).select(F.col(run).alias("run")).mapInArrow(counted, "ch bigint, by bigint, n bigint")
    return rows.groupBy("ch", "by").agg(F.sum("n").alias("n"))


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each character the inner nodes from the root to it, with the branch taken (0 or 1)."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    for node in range(n, 2 * n - 1):
        for branch in (0, 1):
            c, i = heapq.heappop(heap)
            above[i] = (node, branch)
            total = c if not branch else total + c
        heapq.heappush(heap, (total, node))
    paths = []
    for i in range(n):
        path, at = [], i
        while at in above:
            at, branch = above[at]
            path.append((at - n, branch))
        paths.append(path[::-1])
    return paths


def _learnt(ch: np.ndarray, by: np.ndarray, n: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, paths, rate: float):
    """One epoch of a task: its characters, their vectors, the vectors of the nodes and the counts these come from."""
    own, place = np.unique(ch, return_inverse=True)
    per = max(1, BLOCK_CELLS // max(len(nodes), 1))
    taken, all_ = [], []
    for a in range(0, len(own), per):
        block = np.zeros((2, min(per, len(own) - a), len(nodes)), np.float32)
        for i in np.flatnonzero((place >= a) & (place < a + per)).tolist():
            for node, branch in paths[by[i]]:
                block[branch, place[i] - a, node] += n[i]
        taken.append(block[0]), all_.append(block[0] + block[1])
    mine, nodes = vectors[own].astype(np.float32), nodes.astype(np.float32)
    # a step goes as far as the single steps it stands for, FARTHEST at most
    scale = lambda seen: (np.minimum(FARTHEST, rate * seen / SUBSTEPS) / np.maximum(seen, 1e-9))[:, None]
    of_char, of_node = [scale(x.sum(1)) for x in all_], [scale(x.sum(0)) for x in all_]
    for _ in range(SUBSTEPS):
        for k, a in enumerate(range(0, len(own), per)):
            w = mine[a:a + per]
            error = taken[k] - all_[k] / (1 + np.exp(-np.clip(w @ nodes.T, -30, 30)))
            mine[a:a + per], nodes = w + of_char[k] * (error @ nodes), nodes + of_node[k] * (error.T @ w)
    return own, mine, nodes, sum(x.sum(0) for x in all_)


def char2vec(runs: DataFrame, run: str = "run", size: int = VECTOR_SIZE, epochs: int = EPOCHS,
             partitions: int | None = None, seed: int = SEED) -> DataFrame:
    """(ch, vector): skip-gram vectors of characters (hierarchical softmax). The vocabulary is a set of characters, so the vectors
    on the driver are bounded by Unicode. ``partitions``: training tasks of an epoch at most, by default as many as the session
    runs at once."""
    spark = runs.sparkSession
    counts = as_table(pair_counts(runs, run), "char-pairs")
    single = counts.where("by = -1").where(F.col("n") >= MIN_COUNT).select("ch", "n").toPandas().sort_values("ch")
    codes, total = single["ch"].to_numpy(), single["n"].to_numpy()
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((len(codes), size)) - 0.5) / size).astype(np.float32)
    nodes = np.zeros((max(len(codes) - 1, 0), size), np.float32)
    parts = max(1, min(partitions or spark.sparkContext.defaultParallelism, len(codes) // TASK_CHARS))
    dealt = as_table(counts.where("by <> -1").repartition(parts, "ch"), "char-pairs-dealt")
    paths = spark.sparkContext.broadcast(huffman(total))

    for epoch in range(epochs if len(nodes) else 0):
        rate = RATE * max(1 - epoch / epochs, 1e-4)
        start = spark.sparkContext.broadcast((vectors, nodes))

        def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if not held:
                return
            ch, by, n = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("ch", "by", "n"))
            own, mine, moved, seen = _learnt(np.searchsorted(codes, ch), np.searchsorted(codes, by), n / WINDOW, *start.value, paths.value, rate)
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([own, -1 - some])), pa.array(np.concatenate([np.ones(len(own)), seen[some]]).astype(float)),
                 pa.array(list(np.concatenate([mine, moved[some]]).astype(float)), pa.list_(pa.float64()))], ["id", "n", "v"])

        # a row for each character and, from each task, for each node
        rows = dealt.select("ch", "by", "n").mapInArrow(learnt, "id bigint, n double, v array<double>").toArrow()
        ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
        v = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), size)
        vectors, sums, weight = vectors.copy(), np.zeros(nodes.shape), np.zeros(len(nodes))
        vectors[ids[ids >= 0]] = v[ids >= 0]
        inner = ids < 0
        np.add.at(sums, -1 - ids[inner], v[inner] * n[inner, None])
        np.add.at(weight, -1 - ids[inner], n[inner])
        nodes = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1e-9)[:, None], nodes).astype(np.float32)
        start.unpersist()
    return spark.createDataFrame([(chr(c), x) for c, x in zip(codes.tolist(), vectors.astype(float).tolist())], "ch string, vector array<double>")


def char_vectors(model: DataFrame) -> DataFrame:
    """(ch, vector)."""
    return model.select("ch", "vector")
