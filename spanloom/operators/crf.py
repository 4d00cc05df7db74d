"""Linear-chain conditional random fields trained on whole sequences, several models in one pass.

Features are strings with an exact number each (no hashing, hence no collisions). A training table holds one row
per labelled sentence and run: feature numbers and numeric features of its characters, and its labels. Models
differ by run (which sentences they learn from) and by level (which features they may use). One Spark job
evaluates all of them: tasks run forward and backward over their sentences for all levels at once and hand on one
sum per run. The driver keeps the weights and takes the steps of an orthant-wise quasi-Newton method (L1 and L2
penalties), all models in step. Weights that the L1 penalty leaves at zero are dropped: the fitted model is a
table of non-zero weights by feature, and scoring is a join with it and a sum.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.labels import (
    BIES, LEGAL_END, LEGAL_NEXT, LEGAL_START, bies_to_words, joint_label_index, joint_to_words_tags, words_tags_to_joint, words_to_bies)
from spanloom.functions.script import characters
from spanloom.operators import match
from spanloom.operators.features import OUTSIDE, WINDOW_FEATURES, character_flags, window_features
from spanloom.plans.scale import exact_rank, fits_broadcast, lookup_join, seeded_hash
from spanloom.session import as_table

# Regularisation and limits of the reference tagger.
C1, C2, MAX_ITER = 1.0, 1e-3, 200
#: Partitions of a training table, at least, and characters of one, about: each hands the driver one sum per run and step.
PARTS, PART_CHARS = 16, 1 << 22
#: Characters of a block of a training table, about.
BLOCK_CHARS = 1 << 17
#: Steps remembered, and the stopping rule: relative gain over so many steps.
MEMORY, PERIOD, DELTA = 6, 10, 1e-5
#: Characters whose scores a task holds at once, about, for one level and label.
CELLS = 1 << 22
IMPOSSIBLE = -1e9


# --- evaluation within a task ------------------------------------------------------------------
def by_length(sizes: np.ndarray, width: int):
    """Groups of sentences (their places, longest first) of bounded size; ``width`` numbers are held per character."""
    order = np.argsort(-sizes, kind="stable")
    most, k = max(1, CELLS // width), 0
    while k < len(order) and sizes[order[k]] > 0:
        n = max(1, most // int(sizes[order[k]]))
        part = order[k:k + n]
        yield part[sizes[part] > 0]
        k += n


def layout(sizes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Per place in the sentences (longest first), the rows of the sentences that reach it."""
    return [starts[:np.searchsorted(-sizes, -t, "left")] + t for t in range(int(sizes[0]))]


def sequence_sums(scores: np.ndarray, trans: np.ndarray, sizes: np.ndarray, starts: np.ndarray):
    """(log Z per sentence and level, marginals, expected transitions) of sentences, longest first.

    ``scores``: (rows, levels, labels), sentence by sentence; ``trans``: (levels, labels, labels); ``starts``: first rows.
    Forward and backward are scaled per character, and each character's scores by their maximum.
    """
    top = scores.max(2)
    x = np.exp(scores - top[:, :, None])
    high = trans.max((1, 2))
    t = np.exp(trans - high[:, None, None])
    rows = layout(sizes, starts)
    alpha, scale = np.empty_like(x), np.empty(top.shape)
    for i, r in enumerate(rows):
        a = x[r] if i == 0 else (alpha[r - 1].transpose(1, 0, 2) @ t).transpose(1, 0, 2) * x[r]
        s = a.sum(2)
        alpha[r], scale[r] = a / s[:, :, None], s
    beta, pairs = np.ones_like(x), np.zeros_like(trans)
    for i in range(len(rows) - 1, 0, -1):
        r = rows[i]
        ahead = (x[r] * beta[r] / scale[r][:, :, None]).transpose(1, 0, 2)
        beta[r - 1] = (ahead @ t.transpose(0, 2, 1)).transpose(1, 0, 2)
        pairs += alpha[r - 1].transpose(1, 2, 0) @ ahead
    number = np.repeat(np.arange(len(sizes)), sizes)
    logz = np.zeros((len(sizes), trans.shape[0]))
    np.add.at(logz, number, np.log(scale) + top)
    return logz + (sizes - 1)[:, None] * high, alpha * beta, pairs * t


def emission_scores(theta: np.ndarray, ids: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """(rows, levels, labels): weights of the named features plus numeric features times theirs; -1 names no feature.

    ``theta``: (features + numeric features + labels, levels, labels); the last rows are the transitions.
    """
    levels, labels = theta.shape[1:]
    named = len(theta) - dense.shape[1] - labels
    weights = np.concatenate([theta[:named], np.zeros((1, levels, labels))]).reshape(named + 1, levels * labels)
    out = dense @ theta[named:named + dense.shape[1]].reshape(dense.shape[1], levels * labels)
    for k in range(ids.shape[1]):
        out += weights[ids[:, k]]
    return out.reshape(-1, levels, labels)


def loss_and_gradient(theta: np.ndarray, ids: np.ndarray, dense: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative log-likelihood per level and its gradient, summed over sentences given one after another."""
    levels, labels = theta.shape[1:]
    named, columns = len(theta) - dense.shape[1] - labels, levels * labels
    loss, gradient = np.zeros(levels), np.zeros(theta.shape)
    flat = gradient.reshape(len(theta), columns)
    first = np.cumsum(sizes) - sizes
    for part in by_length(sizes, columns):
        n = sizes[part]
        rows = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in part])
        starts = np.cumsum(n) - n
        i, d, gold = ids[rows], dense[rows], y[rows]
        scores, trans = emission_scores(theta, i, d), theta[-labels:].transpose(1, 0, 2)
        logz, marginals, pairs = sequence_sums(scores, trans, n, starts)
        inner = np.ones(len(rows), bool)
        inner[starts] = False
        a, b = gold[np.flatnonzero(inner) - 1], gold[inner]
        seen = np.bincount(a * labels + b, minlength=labels * labels).reshape(labels, labels)
        loss += logz.sum(0) - scores[np.arange(len(rows)), :, gold].sum(0) - (trans * seen).sum((1, 2))
        marginals[np.arange(len(rows)), :, gold] -= 1
        off = marginals.reshape(len(rows), columns)
        flat[named:named + d.shape[1]] += d.T @ off
        for k in range(i.shape[1]):
            order = np.argsort(i[:, k], kind="stable")
            feature = i[order, k]
            at = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]])
            sums = np.add.reduceat(off[order], at)
            has = feature[at] >= 0
            flat[feature[at][has]] += sums[has]
        gradient[-labels:] += (pairs - seen).transpose(1, 0, 2)
    return loss, gradient


# --- blocks: sentences of one run as a step reads them ---------------------------------------------
def distinct_rows(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different row, and for every row the number of its like."""
    number = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values, code = np.unique(c, return_inverse=True)
        number = np.unique(number * len(values) + code, return_inverse=True)[1]
    first, number = np.unique(number, return_index=True, return_inverse=True)[1:]
    return first, number


@dataclass
class Block:
    """Sentences of one run, longest first, character by character: all first ones, all second ones, and so on.

    ``active``: sentences with a character there. Features that go together stand once for each different combination: ``ids`` and
    ``dense`` hold (columns, table of combinations, the combination of each character).
    """

    active: np.ndarray
    y: np.ndarray
    ids: list[tuple[list[int], np.ndarray, np.ndarray]]
    dense: list[tuple[list[int], np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: np.ndarray, dense: np.ndarray, y: np.ndarray, sizes: np.ndarray, apart: Sequence[Sequence[int]]) -> "Block":
        """Of sentences given one after another; ``apart``: the numeric columns that go together."""
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = layout(sizes[order], (np.cumsum(sizes) - sizes)[order])
        rows = np.concatenate(at)

        def combined(values: np.ndarray, groups):
            out = []
            for columns in groups:
                own = values[rows][:, columns]
                first, number = distinct_rows(list(own.T))
                out.append((list(columns), own[first], number.astype(np.uint16 if len(first) <= 1 << 16 else np.int32)))
            return out

        together = WINDOW_GROUPS if ids.shape[1] == len(WINDOW_FEATURES) else [[k] for k in range(ids.shape[1])]
        return Block(np.array([len(r) for r in at]), y[rows].astype(np.int16), combined(ids.astype(np.int32), together), combined(dense, apart))

    def sums(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``loss_and_gradient``, level by level."""
        parts = [self._level(theta[:, k]) for k in range(theta.shape[1])]
        return np.array([p[0] for p in parts]), np.stack([p[1] for p in parts], 1)

    def _level(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        labels, n, y = theta.shape[1], len(self.y), self.y.astype(np.int64)
        named = len(theta) - labels - sum(len(columns) for columns, _, _ in self.dense)
        weights = np.concatenate([theta[:named], np.zeros((1, labels))])
        scores = np.zeros((n, labels))
        for _, table, at in self.ids:
            scores += weights[table].sum(1)[at]
        for columns, table, at in self.dense:
            scores += (table @ theta[named:][columns])[at]
        logz, off, pairs = chain_sums(scores, theta[-labels:], self.active)
        place = np.arange(n)
        inner = place[self.active[0]:]
        seen = np.bincount(y[inner - np.repeat(self.active[:-1], self.active[1:])] * labels + y[inner], minlength=labels * labels).reshape(labels, labels)
        loss = logz - scores[place, y].sum() - (theta[-labels:] * seen).sum()
        off[place, y] -= 1
        off = np.ascontiguousarray(off.T)
        gradient = np.zeros(theta.shape)
        summed = lambda at, u: np.stack([np.bincount(at, o, u) for o in off], 1)
        sums = [(table, summed(at, len(table))) for _, table, at in self.ids]
        feature = np.concatenate([table.T.ravel() for table, _ in sums])
        value = np.concatenate([np.tile(s, (table.shape[1], 1)) for table, s in sums])
        feature[feature < 0] = named
        for k in range(labels):
            gradient[:named, k] = np.bincount(feature, value[:, k], named + 1)[:named]
        for columns, table, at in self.dense:
            gradient[named + np.array(columns)] += table.T @ summed(at, len(table))
        gradient[-labels:] = pairs - seen
        return loss, gradient

    def observed(self, named: int, numeric: int, labels: int) -> np.ndarray:
        """(weights, labels): the features seen with a label, and all transitions."""
        out, y = np.zeros((named + numeric + labels, labels), bool), self.y.astype(np.int64)
        out[-labels:] = True
        for kind, groups in (("ids", self.ids), ("dense", self.dense)):
            for columns, table, at in groups:
                row, label = np.nonzero(np.bincount(at.astype(np.int64) * labels + y, minlength=len(table) * labels).reshape(-1, labels))
                for k, column in enumerate(columns):
                    own = table[row, k]
                    if kind == "ids":
                        out[own[own >= 0], label[own >= 0]] = True
                    else:
                        out[named + column, label[own != 0]] = True
        return out


def chain_sums(scores: np.ndarray, trans: np.ndarray, active: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """As ``sequence_sums`` for one level of sentences laid out as in a ``Block``; log Z summed."""
    top, high = scores.max(1), trans.max()
    x, t = np.exp(scores - top[:, None]), np.exp(trans - high)
    first = (np.cumsum(active) - active).tolist()
    alpha, scale, beta, pairs = np.empty_like(x), np.empty(len(x)), np.ones_like(x), np.zeros_like(trans)
    sizes = active.tolist()
    for i, m in enumerate(sizes):
        own = slice(first[i], first[i] + m)
        a = x[own] if i == 0 else (alpha[first[i - 1]:first[i - 1] + m] @ t) * x[own]
        s = a.sum(1)
        alpha[own], scale[own] = a / s[:, None], s
    x /= scale[:, None]
    for i in range(len(sizes) - 1, 0, -1):
        m = sizes[i]
        own, before = slice(first[i], first[i] + m), slice(first[i - 1], first[i - 1] + m)
        ahead = x[own] * beta[own]
        beta[before] = ahead @ t.T
        pairs += alpha[before].T @ ahead
    return float(np.log(scale).sum() + top.sum() + (len(x) - sizes[0]) * high), alpha * beta, pairs * t


def best_labels(scores: np.ndarray, trans: np.ndarray, sizes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(rows, levels): labels of the best path of each sentence; ties take the lowest label.

    Scores as for sequence_sums, sentences longest first and one after another. Back-pointers are kept per
    character, and one walk back reads the paths.
    """
    rows = layout(sizes, np.cumsum(sizes) - sizes)
    back = np.zeros(scores.shape, np.int16)
    best = scores.copy()
    best[rows[0]] += start
    for r in rows[1:]:
        through = best[r - 1][:, :, :, None] + trans
        back[r] = through.argmax(2)
        best[r] += through.max(2)
    out = np.empty(scores.shape[:2], np.int64)
    last = np.cumsum(sizes) - 1
    out[last] = (best[last] + end).argmax(2)
    for r in reversed(rows[1:]):
        out[r - 1] = np.take_along_axis(back[r], out[r][:, :, None], 2)[:, :, 0]
    return out


# --- the optimiser -----------------------------------------------------------------------------
def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per model: products over its weights; arrays are (runs, weights, levels, labels)."""
    return np.einsum("rfly,rfly->rl", a, b)


def _spread(x: np.ndarray) -> np.ndarray:
    return x[:, None, :, None]


def pseudo_gradient(theta: np.ndarray, gradient: np.ndarray, c1: float) -> np.ndarray:
    """The gradient of loss plus c1 |theta|; at zero the one-sided slope towards lower values, 0 if there is none."""
    at_zero = np.where(gradient + c1 < 0, gradient + c1, np.where(gradient - c1 > 0, gradient - c1, 0.0))
    return np.where(theta != 0, gradient + c1 * np.sign(theta), at_zero)


def minimise(evaluate: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], mask: np.ndarray, c1: float = C1,
             c2: float = C2, max_iter: int = MAX_ITER) -> np.ndarray:
    """Minimise loss + c1 |theta| + c2 theta^2 for all models at once; weights outside ``mask`` stay zero.

    ``evaluate(theta, wanted)`` gives losses (runs, levels) and gradients of the wanted models. Orthant-wise limited-memory quasi-Newton: two-loop
    recursion on the pseudo-gradient, steps projected onto the orthant of their start, halved until they gain
    enough. A model that gains less than DELTA in PERIOD steps rests while others go on.
    """
    theta = np.zeros(mask.shape)

    going = np.ones((mask.shape[0], mask.shape[2]), bool)

    def objective(t, wanted):
        loss, g = evaluate(t, wanted)
        return loss + c2 * _dot(t, t) + c1 * np.einsum("rfly->rl", np.abs(t)), (g + 2 * c2 * t) * mask

    value, gradient = objective(theta, going)
    past, steps = [value], []
    for _ in range(max_iter):
        slope = pseudo_gradient(theta, gradient, c1) * mask
        norm = np.sqrt(_dot(slope, slope))
        going &= norm > 1e-12
        if not going.any():
            break
        q, alphas = slope.copy(), []
        for s, d, rho in reversed(steps):
            alphas.append(rho * _dot(s, q))
            q -= _spread(alphas[-1]) * d
        if steps:
            gamma = np.ones(value.shape)
            for s, d, rho in steps:  # of each model the latest step that told its curvature
                gamma = np.where(rho > 0, 1 / np.maximum(rho * _dot(d, d), 1e-300), gamma)
            q *= _spread(gamma)
        for (s, d, rho), alpha in zip(steps, reversed(alphas)):
            q += s * _spread(alpha - rho * _dot(d, q))
        direction = np.where(q * slope > 0, -q, 0.0)
        known = np.any([rho > 0 for _, _, rho in steps], axis=0) if steps else np.zeros(value.shape, bool)
        length = np.where(known, 1.0, 1 / np.maximum(norm, 1e-12)) * going
        orthant = np.where(theta != 0, np.sign(theta), -np.sign(slope))
        new, new_value, new_gradient, open_ = theta, value, gradient, going.copy()
        for _ in range(20):
            trial = theta + _spread(length) * direction
            new = np.where(_spread(open_), np.where(trial * orthant > 0, trial, 0.0), new)
            tried_value, tried_gradient = objective(new, open_)
            new_value, new_gradient = np.where(open_, tried_value, new_value), np.where(_spread(open_), tried_gradient, new_gradient)
            open_ &= ~(new_value <= value + 1e-4 * _dot(slope, new - theta))
            if not open_.any():
                break
            length = np.where(open_, length / 2, length)
        if open_.any():  # no gain in sight: these stay where they are
            new = np.where(_spread(open_), theta, new)
            new_gradient = np.where(_spread(open_), gradient, new_gradient)
            new_value = np.where(open_, value, new_value)
            going &= ~open_
        s, d = new - theta, new_gradient - gradient
        curve = _dot(s, d)
        steps.append((s, d, np.where(going & (curve > 1e-10), 1 / np.maximum(curve, 1e-10), 0.0)))
        steps = steps[-MEMORY:]
        theta, value, gradient = new, new_value, new_gradient
        past.append(value)
        if len(past) > PERIOD:
            going &= ~(past[-1 - PERIOD] - value < DELTA * np.abs(value))
    return theta


# --- training tables ---------------------------------------------------------------------------
def named_features(window: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(sid, pos, *keep, k, feature): ``name=value`` of the k-th feature of the window, null where it has none."""
    names = F.array(*[F.concat(F.lit(f"{n}="), F.col(f"`{n}`")) for n in WINDOW_FEATURES])
    return window.select("sid", "pos", *keep, F.posexplode(names).alias("k", "feature"))


def feature_index(rows: DataFrame, min_count: int = 1) -> DataFrame:
    """(feature, id) of all features seen at least so often, numbered 0, 1, ... without gaps; ``rows`` may carry a count ``cnt`` each."""
    seen = F.sum("cnt") if "cnt" in rows.columns else F.count(F.lit(1))
    counts = rows.where("feature IS NOT NULL").groupBy("feature").agg(seen.alias("cnt")).where(F.col("cnt") >= min_count)
    digested = as_table(counts.select("feature", seeded_hash("crf", "feature").alias("digest")), "crf-features")
    return as_table(exact_rank(digested, "digest", "feature", rank="id", total="n").select("feature", F.col("id").cast("int").alias("id")), "crf-index")


def flat_numeric(extra: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(sid, dense): the numeric columns of a sentence, character by character."""
    values = F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in numeric])
    return extra.select("sid", "pos", values.alias("v")).groupBy("sid").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])).alias("dense"))


def encoded(sent: DataFrame, singles: DataFrame, index: DataFrame, extra: DataFrame | None, numeric: Sequence[str]) -> DataFrame:
    """(sid, ids, dense): feature numbers and numeric features of a sentence, character by character; -1 names no known feature.

    Sentences are dealt out by sid once, so that gathering their characters needs no further shuffle.
    """
    dealt = sent.where(F.length("s") > 0).repartition("sid")
    rows = named_features(window_features(dealt, singles, by_run="in_run" in singles.columns))
    found = rows.join(F.broadcast(index) if fits_broadcast(index) else index, "feature", "left")
    ids = found.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "pos", "k", F.coalesce("id", F.lit(-1)).alias("id")))), lambda x: x["id"]).alias("ids"))
    return ids.withColumn("dense", F.array().cast("array<double>")) if extra is None else ids.join(flat_numeric(extra, numeric), "sid")


def training_table(sent: DataFrame, singles: DataFrame, y: Column, extra: DataFrame | None, numeric: Sequence[str],
                   min_count: int = 1, runs: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, index): per sentence of ``sent`` (sid, run, words, s) its feature numbers, numeric features and labels ``y``.

    ``sid`` is unique per row; a sentence that several runs learn from comes once for each, with ids of their own.
    """
    labelled = sent.where(F.length("s") > 0)
    index = feature_index(named_features(window_features(labelled, singles, by_run="in_run" in singles.columns)), min_count)
    out = labelled.select("sid", "run", y.alias("y")).join(encoded(labelled, singles, index, extra, numeric), "sid")
    return as_table(out.select("run", "ids", "dense", "y"), "crf-rows"), index


#: Window features that go together: those of a character and the one before, and of the one behind.
WINDOW_GROUPS = [[0, 1, 5, 7, 8, 9, 10], [2, 6], [3], [4]]
BLOCKS = "run int, size bigint, block binary"


def apart(numeric: Sequence[str]) -> list[list[int]]:
    """The numeric features that go together: those of the gap before a character, of the gap behind, and all others."""
    sides = [[j for j, n in enumerate(numeric) if n[:2] == side] for side in ("L_", "R_")]
    both = sum(sides, [])
    return [g for g in [[j for j in range(len(numeric)) if j not in both], *sides] if g]


class Blocks:
    """Gathers sentences by run and gives them out as blocks of about BLOCK_CHARS characters."""

    def __init__(self, numeric: Sequence[Sequence[int]]):
        self.numeric, self.held = numeric, {}

    def add(self, run: int, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        held = self.held.setdefault(run, [])
        held.append(arrays)
        if sum(len(a[2]) for a in held) >= BLOCK_CHARS:
            yield from self._out(run)

    def rest(self) -> Iterator[tuple[int, int, bytes]]:
        for run in list(self.held):
            yield from self._out(run)

    def _out(self, run: int) -> Iterator[tuple[int, int, bytes]]:
        whole = [np.concatenate(a) for a in zip(*self.held.pop(run))]
        if len(whole[2]):
            yield run, len(whole[2]), pickle.dumps(Block.of(*whole, self.numeric), 5)


def packed(rows: DataFrame, groups: Sequence[Sequence[int]]) -> DataFrame:
    """(run, size, block) of the sentences of a training table; ``groups``: the numeric features that go together."""
    numeric = sum(map(len, groups))

    def run(batches):
        blocks = Blocks(groups)
        frame = lambda found: pd.DataFrame(found, columns=["run", "size", "block"])
        for batch in batches:
            for number, part in batch.groupby("run"):
                for k in range(0, len(part), 1000):
                    yield frame(list(blocks.add(int(number), *_arrays(part.iloc[k:k + 1000], numeric))))
        yield frame(list(blocks.rest()))

    return rows.select("run", "ids", "dense", "y").mapInPandas(run, BLOCKS)


def dealt_blocks(blocks: DataFrame, runs: int, name: str = "crf-blocks") -> DataFrame:
    """(run, block), each run in partitions of its own of about PART_CHARS characters, as each hands on sums of all weights of its runs."""
    kept = as_table(blocks, name)
    most = kept.groupBy("run").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
    each = max(1, PARTS // runs, math.ceil(most / PART_CHARS))
    place = F.col("run") * each + F.pmod(F.xxhash64("block"), F.lit(each)).cast("int")
    return kept.repartitionById(each * runs, place).select("run", "block")


def _arrays(part: pd.DataFrame, numeric: int):
    sizes = part["y"].map(len).to_numpy(np.int64)
    whole = lambda c: np.concatenate(part[c].to_numpy()) if len(part) else np.zeros(0)
    n = int(sizes.sum())
    return (whole("ids").astype(np.int64).reshape(n, -1), whole("dense").astype(float).reshape(n, numeric), whole("y").astype(np.int64), sizes)


def evaluator(rows: DataFrame, runs: int, numeric: int):
    """A function of all weights to losses and gradients: one job over the training table, or its blocks."""
    sc = rows.sparkSession.sparkContext
    blocks = rows if "block" in rows.columns else packed(rows, [list(range(numeric))] if numeric else [])

    def evaluate(theta: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which = {r: np.flatnonzero(w) for r, w in enumerate(wanted) if w.any()}
        shared = sc.broadcast({r: np.ascontiguousarray(theta[r][:, levels]) for r, levels in which.items()})

        def run(batches):
            sums = {}
            for batch in batches:
                for number, data in zip(batch["run"], batch["block"]):
                    if number not in shared.value:
                        continue
                    loss, gradient = pickle.loads(data).sums(shared.value[number])
                    if number in sums:
                        loss, gradient = sums[number][0] + loss, sums[number][1] + gradient
                    sums[number] = loss, gradient
            yield pd.DataFrame([(n, a.tobytes(), b.tobytes()) for n, (a, b) in sums.items()], columns=["run", "loss", "gradient"])

        losses, gradients = np.zeros((runs, theta.shape[2])), np.zeros(theta.shape)
        for part in blocks.select("run", "block").mapInPandas(run, "run int, loss binary, gradient binary").collect():  # a row per run and partition
            r = part["run"]
            losses[r, which[r]] += np.frombuffer(part["loss"])
            gradients[r][:, which[r]] += np.frombuffer(part["gradient"]).reshape(theta.shape[1], -1, theta.shape[3])
        shared.destroy()
        return losses, gradients

    return evaluate


def observed(blocks: DataFrame, runs: int, features: int, numeric: int, labels: int) -> np.ndarray:
    """(runs, weights, labels): features seen with a label in a run's sentences, and all transitions."""
    def run(batches):
        sums = {}
        for batch in batches:
            for number, data in zip(batch["run"], batch["block"]):
                sums[number] = sums.get(number, False) | pickle.loads(data).observed(features, numeric, labels)
        yield pd.DataFrame([(n, np.packbits(s).tobytes()) for n, s in sums.items()], columns=["run", "seen"])

    out = np.zeros((runs, features + numeric + labels, labels), bool)
    for part in blocks.mapInPandas(run, "run int, seen binary").collect():
        bits = np.unpackbits(np.frombuffer(part["seen"], np.uint8), count=out[0].size)
        out[part["run"]] |= bits.reshape(out[0].shape).astype(bool)
    return out


def fit_theta(rows: DataFrame, index: DataFrame, runs: int, numeric: Sequence[str], levels: Sequence[Sequence[str]], labels: int,
              c1: float = C1, c2: float = C2, max_iter: int = MAX_ITER) -> np.ndarray:
    """All weights (runs, features + numeric features + labels, levels, labels); ``levels`` lists the numeric features each may use."""
    features = index.count()
    allowed = np.ones((features + len(numeric) + labels, len(levels)), bool)
    for j, name in enumerate(numeric):
        allowed[features + j] = [name in level for level in levels]
    rows = dealt_blocks(rows if "block" in rows.columns else packed(rows, apart(numeric)), runs).persist(StorageLevel.MEMORY_AND_DISK)
    mask = observed(rows, runs, features, len(numeric), labels)[:, :, None, :] & allowed[None, :, :, None]
    theta = minimise(evaluator(rows, runs, len(numeric)), mask, c1, c2, max_iter)
    rows.unpersist()
    return theta


def weight_table(theta: np.ndarray, index: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(run, feature, w), w an array over levels and labels; features whose weights are all zero are left out."""
    spark, labels = index.sparkSession, theta.shape[3]
    features = theta.shape[1] - len(numeric) - labels
    run, place = np.nonzero((theta[:, :-labels] != 0).any((2, 3)))
    w = theta[run, place].reshape(len(run), theta.shape[2] * labels)
    named = place < features
    table = lambda part: spark.createDataFrame(
        [(int(r), int(p), x.tolist()) for r, p, x in zip(run[part], place[part], w[part])], "run int, id int, w array<double>")
    names = F.array(*[F.lit(n) for n in numeric]) if numeric else F.array().cast("array<string>")
    return as_table(table(named).join(index, "id").select("run", "feature", "w").unionAll(
        table(~named).select("run", F.element_at(names, F.col("id") - features + 1), "w")), "crf-weights")


# --- scoring -----------------------------------------------------------------------------------
def emissions(sent: DataFrame, singles: DataFrame, extra: DataFrame | None, numeric: Sequence[str], weights: DataFrame, width: int,
              by_run: bool = False) -> DataFrame:
    """(sid, e): per character ``width`` scores, one after another, by a join of its features with the weights and a sum."""
    keep = ["run"] if by_run else []
    rows = named_features(window_features(sent.repartition("sid"), singles, by_run=by_run), keep).select("sid", "pos", *keep, "feature", F.lit(1.0).alias("value"))
    if extra is not None:
        if by_run:
            extra = extra.join(sent.select("sid", "run"), "sid")
        items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").cast("double").alias("value")) for n in numeric])
        rows = rows.unionAll(extra.select("sid", "pos", *keep, F.explode(F.filter(items, lambda x: x["value"] != 0)).alias("x")).select(
            "sid", "pos", *keep, "x.feature", "x.value"))
    on = [*keep, "feature"]
    found = lookup_join(rows, weights.select(*on, "w"), on, "left", small_fits=fits_broadcast(weights))
    sums = [F.coalesce(F.sum(F.col("value") * F.element_at("w", i + 1)), F.lit(0.0)) for i in range(width)]
    scored = found.groupBy("sid", "pos").agg(*[s.alias(f"e{i}") for i, s in enumerate(sums)]).select(
        "sid", "pos", F.array(*[f"e{i}" for i in range(width)]).alias("e"))
    return scored.groupBy("sid").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"])).alias("e"))


def transitions_of(theta: np.ndarray) -> np.ndarray:
    """(runs, levels, labels, labels) of all weights."""
    return theta[:, -theta.shape[3]:].transpose(0, 2, 1, 3)


def _paths(scores_of, start: np.ndarray, end: np.ndarray, transitions: np.ndarray, size_of: Callable[[pd.DataFrame], pd.Series]):
    """Rows of sentences to (sid, paths); ``scores_of(rows, run)`` gives the scores of sentences one after another."""
    levels, labels = transitions.shape[1:3]

    def run(batches):
        for batch in batches:
            sizes = size_of(batch).to_numpy(np.int64)
            paths = [[np.zeros(0, np.int32)] * levels for _ in sizes]
            runs = batch["run"].to_numpy()
            for number in np.unique(runs):
                places = np.flatnonzero(runs == number)
                for own in by_length(sizes[places], levels * labels * labels):
                    at = places[own]
                    scores = scores_of(batch.iloc[at], number).reshape(-1, levels, labels)
                    found = best_labels(scores, transitions[number], sizes[at], start, end).astype(np.int32)
                    for i, one in zip(at, np.split(found, np.cumsum(sizes[at])[:-1])):
                        paths[i] = list(np.ascontiguousarray(one.T))
            yield pd.DataFrame({"sid": batch["sid"].array, "paths": paths})

    return run


def decode(scored: DataFrame, transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> DataFrame:
    """(sid, paths): per level the label numbers of the best path; ``scored`` is (sid, run, e), transitions by run and level."""
    width = transitions.shape[1] * transitions.shape[2]
    run = _paths(lambda rows, _: np.concatenate(rows["e"].to_numpy()), start, end, transitions, lambda batch: batch["e"].map(len) // width)
    return scored.select("sid", "run", "e").mapInPandas(run, "sid bigint, paths array<array<int>>")


def decode_encoded(rows: DataFrame, theta: np.ndarray, barred: np.ndarray, start: np.ndarray, end: np.ndarray) -> DataFrame:
    """As ``decode``, of rows (sid, run, ids, dense), with all weights at hand in the tasks; ``barred`` is added to transitions."""
    shared = rows.sparkSession.sparkContext.broadcast(theta)

    def scores_of(part, number):
        ids = np.concatenate(part["ids"].to_numpy()).astype(np.int64).reshape(-1, len(WINDOW_FEATURES))
        dense = np.concatenate(part["dense"].to_numpy()).astype(float)
        dense = dense.reshape(len(ids), len(dense) // len(ids))
        return emission_scores(shared.value[number], ids, dense)

    run = _paths(scores_of, start, end, transitions_of(theta) + barred, lambda batch: batch["ids"].map(len) // len(WINDOW_FEATURES))
    return rows.select("sid", "run", "ids", "dense").mapInPandas(run, "sid bigint, paths array<array<int>>")


# --- tagging in the sentence's row -----------------------------------------------------------------
#: The number of a place outside the sentence, after all code points.
BEYOND = 0x110000


def character_kinds(spark: SparkSession) -> np.ndarray:
    """By code point the kinds of ``window_features`` as bits: digit, letter, punctuation."""
    code = spark.range(BEYOND).where("id < 55296 OR id > 57343")
    chars = code.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("ch"))
    bits = sum((F.when(kind, 1 << i).otherwise(0) for i, kind in enumerate(character_flags(F.col("ch")))), F.lit(0))
    table = chars.select("id", bits.cast("int").alias("bits")).where("bits > 0").toArrow()
    kinds = np.zeros(BEYOND + 1, np.uint8)
    kinds[table["id"].to_numpy()] = table["bits"].to_numpy()
    return kinds


def neighbours(text: match.Text) -> dict[str, np.ndarray]:
    """The code points of each character and those around it, BEYOND outside the string."""
    codes, row = text.codes.astype(np.int64), text.rows()
    pos = np.arange(text.n) - text.starts[row]
    left = text.sizes[row] - 1 - pos
    shifted = lambda d: np.where(pos >= -d if d < 0 else left >= d, np.roll(codes, -d), BEYOND)
    return {"c0": codes, "c-1": shifted(-1), "c+1": shifted(1), "c-2": shifted(-2), "c+2": shifted(2)}


def counted_features(sent: DataFrame, kinds, singles) -> DataFrame:
    """(feature, cnt): the window features of all sentences (run, s), counted in steps of some thousand characters where they are read.

    ``kinds`` and ``singles`` are broadcast, see ``WindowTable``.
    """
    def counted(batches):
        for batch in match.steps(batches, "s"):
            text = match.Text(batch["s"])
            if not text.n:
                continue
            near, names, counts = neighbours(text), [], []

            def add(found, named):
                values, n = found
                names.extend(map(named, values.tolist()))
                counts.extend(n.tolist())

            for name, d in (("c0", 0), ("c-1", -1), ("c+1", 1), ("c-2", -2), ("c+2", 2)):
                add(np.unique(near[name], return_counts=True), lambda v, name=name, d=d: f"{name}={OUTSIDE[d] if v == BEYOND else chr(v)}")
            for name, a, b in (("c-1_c0", near["c-1"], near["c0"]), ("c0_c+1", near["c0"], near["c+1"])):
                both = (a != BEYOND) & (b != BEYOND)
                add(np.unique((a[both] << 21) | b[both], return_counts=True), lambda v, name=name: f"{name}={chr(v >> 21)}{chr(v & (1 << 21) - 1)}")
            run = batch["run"].to_numpy()[text.rows()]
            flags = [(kinds.value[near["c0"]] >> i) & 1 for i in range(3)] + [np.stack(singles.value)[run, near["c0"]]]
            for name, flag in zip(WINDOW_FEATURES[7:], flags):
                add(np.unique(flag.astype(bool), return_counts=True), lambda v, name=name: f"{name}={v}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["feature", "cnt"])

    return sent.select("run", "s").mapInArrow(counted, "feature string, cnt bigint").groupBy("feature").agg(F.sum("cnt").alias("cnt"))


class WindowTable:
    """The numbers of window features by code point, so that those of a text are read off its characters; -1 for unknown ones."""

    def __init__(self, features: Sequence[str], kinds: np.ndarray, singles: Sequence[np.ndarray]):
        """``features``: ``name=value``, numbered in this order; ``singles``: of each run whether a character is a word there, by code point."""
        self.kinds, self.singles = kinds, singles
        found: dict[str, list[tuple[str, int]]] = {n: [] for n in WINDOW_FEATURES}
        for i, feature in enumerate(features):
            name, _, value = feature.partition("=")
            found[name].append((value, i))
        self.one, self.two, self.flag = {}, {}, {}
        for name, d in (("c0", 0), ("c-1", -1), ("c+1", 1), ("c-2", -2), ("c+2", 2)):
            self.one[name] = np.full(BEYOND + 1, -1, np.int32)
            for value, i in found[name]:
                self.one[name][BEYOND if value == OUTSIDE.get(d) else ord(value)] = i
        for name in ("c-1_c0", "c0_c+1"):
            keys = np.array([(ord(v[0]) << 21) | ord(v[1]) for v, _ in found[name]], np.int64)
            order = np.argsort(keys)
            self.two[name] = np.append(keys[order], -1), np.append(np.array([i for _, i in found[name]], np.int32)[order], -1)
        for name in WINDOW_FEATURES[7:]:
            known = dict(found[name])
            self.flag[name] = np.array([known.get("False", -1), known.get("True", -1)], np.int32)

    def ids(self, text: match.Text, run: np.ndarray | None = None) -> np.ndarray:
        """(characters, features); ``run``: of each character, if there are several."""
        out = np.empty((text.n, len(WINDOW_FEATURES)), np.int64)
        near = neighbours(text)
        codes = near["c0"]
        for k, name in enumerate(WINDOW_FEATURES[:5]):
            out[:, k] = self.one[name][near[name]]
        for k, name, a, b in ((5, "c-1_c0", near["c-1"], codes), (6, "c0_c+1", codes, near["c+1"])):
            keys, ids = self.two[name]
            asked, back = np.unique((a << 21) | b, return_inverse=True)
            at = np.searchsorted(keys[:-1], asked)
            out[:, k] = np.where(keys[at] == asked, ids[at], -1)[back]
        known = self.singles[0][codes] if run is None else np.stack(self.singles)[run, codes]
        flags = [(self.kinds[codes] >> i) & 1 for i in range(3)] + [known.astype(np.int64)]
        for k, (name, flag) in enumerate(zip(WINDOW_FEATURES[7:], flags), 7):
            out[:, k] = self.flag[name][flag]
        return out


@dataclass
class RowTagger:
    """What tasks need to decode sentences: ``weights[run]`` (features, a row of zeros last, by level and label), ``numeric[run]`` and
    ``trans[run]``, legal ones only, and the scores of the ends."""

    window: WindowTable
    weights: Sequence[np.ndarray]
    numeric: Sequence[np.ndarray]
    trans: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @staticmethod
    def of(window: WindowTable, theta: np.ndarray, numeric: int, barred: np.ndarray, start: np.ndarray, end: np.ndarray) -> "RowTagger":
        labels = theta.shape[3]
        named = theta.shape[1] - numeric - labels
        zero, columns = np.zeros((1, *theta.shape[2:])), theta.shape[2] * labels
        return RowTagger(window, [np.concatenate([w[:named], zero]).reshape(named + 1, columns) for w in theta],
                         [w[named:named + numeric].reshape(numeric, columns) for w in theta], transitions_of(theta) + barred, start, end)

    def labels(self, text: match.Text, dense: np.ndarray, run: np.ndarray | None = None) -> np.ndarray:
        """(characters, levels): the labels of the best legal path of each string; ``run``: of each string, if there are several."""
        levels, labels = self.trans.shape[1:3]
        out = np.zeros((text.n, levels), np.int32)
        ids = self.window.ids(text, None if run is None else run[text.rows()])
        runs = np.zeros(len(text.sizes), np.int64) if run is None else run
        for number in np.unique(runs):
            places = np.flatnonzero(runs == number)
            for own in by_length(text.sizes[places], levels * labels * labels):
                at = places[own]
                rows = match._reach(text.starts[at], text.sizes[at])
                scores = dense[rows] @ self.numeric[number]
                for k in range(ids.shape[1]):
                    scores += self.weights[number][ids[rows, k]]
                out[rows] = best_labels(scores.reshape(-1, levels, labels), self.trans[number], text.sizes[at], self.start, self.end)
        return out


def by_code(chars: Sequence[str]) -> np.ndarray:
    known = np.zeros(BEYOND + 1, bool)
    known[[ord(c) for c in chars]] = True
    return known


def training_blocks(sent: DataFrame, y: Column, singles: Sequence[Sequence[str]], numbers: match.Numbers | None, numeric: Sequence[str],
                    min_count: int = 1, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, WindowTable]:
    """(blocks, index, window): the blocks of a training table of ``sent`` (run, s and what ``y`` and ``numbers`` need, the latter as
    ``keep``), made in the sentence's row; ``singles``: of each run the one-character words."""
    spark = sent.sparkSession
    labelled = sent.where(F.length("s") > 0).select("run", "s", *keep, y.alias("y"))
    kinds, known = character_kinds(spark), [by_code(chars) for chars in singles]
    shared = [spark.sparkContext.broadcast(x) for x in (kinds, known)]
    index = feature_index(counted_features(labelled, *shared), min_count)
    window = WindowTable([r["feature"] for r in index.orderBy("id").collect()], kinds, known)  # as many as the driver's weights
    table, groups = spark.sparkContext.broadcast(window), apart(numeric)

    def made(batches):
        blocks = Blocks(groups)
        out = lambda found: pa.RecordBatch.from_pylist([dict(zip(("run", "size", "block"), f)) for f in found], schema=schema)
        schema = pa.schema([("run", pa.int32()), ("size", pa.int64()), ("block", pa.binary())])
        for batch in match.steps(batches, "s"):
            text = match.Text(batch["s"])
            run = batch["run"].to_numpy().astype(np.int64)
            columns = numbers(text, batch) if numbers is not None else []
            dense = np.stack(columns, 1) if columns else np.zeros((text.n, 0))
            arrays = table.value.ids(text, run[text.rows()]).astype(np.int32), dense, batch["y"].flatten().to_numpy()
            for number in np.unique(run):
                own = run == number
                at = own[text.rows()]
                yield out(list(blocks.add(int(number), *[a[at] for a in arrays], text.sizes[own])))
        yield out(list(blocks.rest()))

    return labelled.mapInArrow(made, BLOCKS), index, window


def label_rows(sent: DataFrame, shared, numbers: match.Numbers | None) -> DataFrame:
    """(sid, s, path): the label numbers of each sentence, made in its row; ``numbers`` makes the numeric features."""
    def run(batches):
        for batch in match.steps(batches, "s"):
            text = match.Text(batch["s"])
            columns = numbers(text, batch) if numbers is not None and text.n else []
            dense = np.stack(columns, 1) if columns else np.zeros((text.n, 0))
            path = shared.value.labels(text, dense)[:, 0] if text.n else np.zeros(0, np.int32)
            offsets = pa.array(np.append(0, text.stops).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["sid"], batch["s"], pa.ListArray.from_arrays(offsets, pa.array(path, pa.int32()))], ["sid", "s", "path"])

    rows = sent.select("sid", "s")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("path", T.ArrayType(T.IntegerType()))]))


def decode_characters(sent: DataFrame, table: DataFrame, start: Sequence[float], trans: Sequence[Sequence[float]], end: Sequence[float]) -> DataFrame:
    """(sid, labels): the best legal labels of each sentence as text, from scores by character; a narrow map, linear in the text.

    ``table``: (ch, e), an array of scores in label order; one row per character, so that Unicode bounds it.
    """
    rows = sorted((ord(r["ch"]), list(r["e"])) for r in table.collect())
    known = np.array([c for c, _ in rows], np.uint32)
    scores = np.array([e for _, e in rows], float).reshape(len(rows), len(BIES))
    barred = lambda w, ok: np.array(w, float) + np.where(np.array(ok), 0.0, IMPOSSIBLE)
    first, last = barred(start, [b in LEGAL_START for b in BIES]), barred(end, [b in LEGAL_END for b in BIES])
    between = barred(trans, [[b in LEGAL_NEXT[a] for b in BIES] for a in BIES])[None, None]

    def scores_of(part, _):
        codes = np.frombuffer("".join(part["s"]).encode("utf-32-le"), "<u4")
        return scores[np.searchsorted(known, codes)]

    paths = _paths(scores_of, first, last, between, lambda batch: batch["s"].str.len())
    labelled = sent.where(F.length("s") > 0).select("sid", F.lit(0).alias("run"), "s").mapInPandas(paths, "sid bigint, paths array<array<int>>")
    names = F.array(*[F.lit(b) for b in BIES])
    return labelled.select("sid", F.array_join(F.transform(F.element_at("paths", 1), lambda i: F.element_at(names, i + 1)), "").alias("labels"))


def bounded_rows(sent: DataFrame, most: int | None, seed: int = 42) -> DataFrame:
    """At most ``most`` rows, those of the smallest hash of ``sid``; all if None."""
    if most is None:
        return sent
    ranked = exact_rank(sent.select("sid", seeded_hash(seed, "sid").alias("digest")), "digest", "sid").where(F.col("rank") < most)
    return sent.join(ranked.select("sid"), "sid", "left_semi")


def single_words(sent: DataFrame) -> DataFrame:
    """(ch): one-character words, bounded by Unicode; written, since every later step reads them."""
    return as_table(sent.select(F.explode("words").alias("ch")).where(F.length("ch") == 1).distinct(), "crf-singles")


# --- the taggers -------------------------------------------------------------------------------
@dataclass
class CharCrf:
    """A fitted model of word boundaries. ``numeric`` names the columns it expects beside the window features."""

    weights: DataFrame
    transitions: np.ndarray
    singles: DataFrame
    labels: list[str]
    numeric: tuple[str, ...] = ()

    @staticmethod
    def label_set(sent: DataFrame) -> list[str]:
        return list(BIES)

    @staticmethod
    def gold() -> Column:
        return words_to_bies(F.col("words"))

    @staticmethod
    def may_follow(a: str, b: str) -> bool:
        return b in LEGAL_NEXT[a]

    @staticmethod
    def words_of(labelled: DataFrame) -> DataFrame:
        """(sid, labels, pred_words) from (sid, s, labels)."""
        return labelled.select("sid", "labels", bies_to_words(characters(F.col("s")), F.col("labels")).alias("pred_words"))

    @classmethod
    def fit(cls, sent: DataFrame, extra: DataFrame | None = None, used: DataFrame | None = None, max_iter: int = MAX_ITER,
            c1: float = C1, c2: float = C2, min_count: int = 1) -> "CharCrf":
        """``sent``: (sid, words, tags, s); ``used``: those of its rows to learn from, all if not given;
        ``extra``: (sid, pos, numeric columns) of these."""
        numeric = tuple(c for c in extra.columns if c not in ("sid", "pos")) if extra is not None else ()
        labels = cls.label_set(sent)
        singles = single_words(sent)
        used = (sent if used is None else used).withColumn("run", F.lit(0))
        names = F.array(*[F.lit(y) for y in labels])
        y = F.transform(cls.gold(), lambda v: (F.array_position(names, v) - 1).cast("int"))
        rows, index = training_table(used, singles, y, extra, numeric, min_count)
        theta = fit_theta(rows, index, 1, numeric, [numeric], len(labels), c1, c2, max_iter)
        return cls(weight_table(theta, index, numeric).drop("run"), transitions_of(theta), singles, labels, numeric)

    @classmethod
    def fit_rows(cls, sent: DataFrame, used: DataFrame, numbers: match.Numbers | None, numeric: Sequence[str], keep: Sequence[str] = (),
                 max_iter: int = MAX_ITER, c1: float = C1, c2: float = C2, min_count: int = 1) -> "CharCrf":
        """As ``fit``, with the training table made in the rows of ``used``; ``numbers`` makes the columns ``numeric`` from ``keep``."""
        labels, singles = cls.label_set(sent), single_words(sent)
        names = F.array(*[F.lit(y) for y in labels])
        y = F.transform(cls.gold(), lambda v: (F.array_position(names, v) - 1).cast("int"))
        chars = [r["ch"] for r in singles.collect()]  # Unicode bounds them
        blocks, index, _ = training_blocks(used.withColumn("run", F.lit(0)), y, [chars], numbers, numeric, min_count, keep)
        theta = fit_theta(blocks, index, 1, numeric, [numeric], len(labels), c1, c2, max_iter)
        return cls(weight_table(theta, index, numeric).drop("run"), transitions_of(theta), singles, labels, tuple(numeric))

    def legal(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of start, inner and end transitions: 0 or impossible."""
        kinds = [y.split("-", 1)[0] for y in self.labels]
        barred = lambda ok: np.where(np.array(ok), 0.0, IMPOSSIBLE)
        return (barred([k in LEGAL_START for k in kinds]), barred([[self.may_follow(a, b) for b in self.labels] for a in self.labels]),
                barred([k in LEGAL_END for k in kinds]))

    def transform(self, sent: DataFrame, extra: DataFrame | None = None) -> DataFrame:
        """(sid, labels, pred_words), one row per sentence; an empty or null text gives empty arrays."""
        start, inner, end = self.legal()
        known = extra.select("sid", "pos", *self.numeric) if self.numeric else None
        scored = emissions(sent.select("sid", "s"), self.singles, known, self.numeric, self.weights, len(self.labels))
        paths = decode(scored.withColumn("run", F.lit(0)), self.transitions + inner, start, end)
        names = F.array(*[F.lit(y) for y in self.labels])
        decoded = paths.select("sid", F.transform(F.element_at("paths", 1), lambda i: F.element_at(names, i + 1)).alias("labels"))
        both = sent.select("sid", "s").join(decoded, "sid", "left").select(
            "sid", F.coalesce("s", F.lit("")).alias("s"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
        return self.words_of(both)

    def transform_rows(self, sent: DataFrame, numbers: match.Numbers | None) -> DataFrame | None:
        """As ``transform``, made in the sentence's row, of sentences with an id of their own; ``numbers`` makes the columns ``numeric``.
        None if the weights are too many for a broadcast."""
        if not fits_broadcast(self.weights):
            return None
        start, inner, end = self.legal()
        rows = self.weights.select("feature", "w").collect()  # bounded by the sentences learnt from
        known = {r["feature"]: np.array(r["w"]) for r in rows}
        named = [f for f in known if f not in self.numeric]
        none = np.zeros(len(self.labels))
        theta = np.array([known[f] for f in named] + [known.get(n, none) for n in self.numeric]).reshape(-1, 1, len(self.labels))
        theta = np.concatenate([theta, self.transitions[0].transpose(1, 0, 2)])[None]
        spark = self.weights.sparkSession
        window = WindowTable(named, character_kinds(spark), [by_code([r["ch"] for r in self.singles.collect()])])  # Unicode bounds them
        shared = spark.sparkContext.broadcast(RowTagger.of(window, theta, len(self.numeric), inner, start, end))
        names = F.array(*[F.lit(y) for y in self.labels])
        labels = F.when(F.col("sid").isNotNull(), F.transform("path", lambda i: F.element_at(names, i + 1)))
        return self.words_of(label_rows(sent, shared, numbers).select(
            "sid", F.coalesce("s", F.lit("")).alias("s"), F.coalesce(labels, F.array().cast("array<string>")).alias("labels")))

    def save(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        self.singles.write.mode("overwrite").parquet(f"{path}/singles")
        meta = json.dumps({"transitions": self.transitions.tolist(), "labels": self.labels, "numeric": self.numeric})
        self.singles.sparkSession.range(1).select(F.lit(meta).alias("value")).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CharCrf":
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return cls(spark.read.parquet(f"{path}/weights"), np.array(meta["transitions"]), spark.read.parquet(f"{path}/singles"),
                   meta["labels"], tuple(meta["numeric"]))


class JointCrf(CharCrf):
    """A fitted model of boundaries and tags together: all characters of a word bear one tag."""

    @staticmethod
    def label_set(sent: DataFrame) -> list[str]:
        labels = [r["label"] for r in joint_label_index(sent.select(F.explode("tags").alias("tag"))).orderBy("id").collect()]  # four per tag
        if not labels:
            raise ValueError("no tagged word to learn from")
        return labels

    @staticmethod
    def gold() -> Column:
        return words_tags_to_joint(F.col("words"), F.col("tags"))

    @staticmethod
    def may_follow(a: str, b: str) -> bool:
        (x, s), (y, t) = a.split("-", 1), b.split("-", 1)
        return y in LEGAL_NEXT[x] and (y in LEGAL_START or s == t)

    @staticmethod
    def words_of(labelled: DataFrame) -> DataFrame:
        out = labelled.select("sid", "labels", joint_to_words_tags(characters(F.col("s")), F.col("labels")).alias("_w"))
        return out.select("sid", "labels", F.transform("_w", lambda x: x["word"]).alias("pred_words"),
                          F.transform("_w", lambda x: x["tag"]).alias("pred_tags"))
