"""Document quality from a linear-chain CRF over lines.

Every non-empty line is a position with two states, good and bad. Its emission is linear in features of the
line and of its neighbours (character classes, repeated words, words ending in symbols), transitions are a
2 x 2 table. Lines learn from the label of their document. A document's quality is the mean marginal of
"good" from forward-backward, weighted by line length, and mapped to a probability by a logistic
calibration fitted on the same documents. All labelled documents outside the held-out fold are learnt from, with all their
lines: on the driver where they are few, else in blocks of lines, of which every step sums the gradient in Spark.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import exact_id
from spanloom.operators.crf import chain_sums
from spanloom.plans.scale import fits_broadcast, lookup_join
from spanloom.session import as_table

#: Lines that are learnt from at once; more are in blocks of about so many. Blocks stay on the driver up to DRIVER_LINES (some 100 MB), beyond
#: they lie in partitions, one in each.
LOCAL_LINES = BLOCK_LINES = 1 << 16
DRIVER_LINES = 1 << 20
THRESHOLD, FOLDS = 0.3, 5
BYTES = 6_000_000
#: Words whose hashes are summed at once.
WORDS_AT_ONCE = 1 << 16

UPPER, LOWER, DIGIT, PUNCT, SYMBOL, HIGH, SPACE, N_CLASS = range(8)
FEATURES = ["length", "upper", "digit", "punct", "symbol", "high", "repeated words", "words ending in a symbol",
            "words of symbols only", "mean word length", "capitalised words", "share of distinct lengths"]
#: Columns also taken from the lines before and after.
NEAR = [1, 4, 6, 7, 8]


def _classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    table[128:] = HIGH
    for low, high, kind in (("A", "Z", UPPER), ("a", "z", LOWER), ("0", "9", DIGIT)):
        table[ord(low):ord(high) + 1] = kind
    table[[ord(c) for c in ".,;:?'\"()-"]] = PUNCT
    table[[32, *range(9, 14)]] = SPACE
    return table


CLASS = _classes()
CODE = np.random.default_rng(5).integers(1, 1 << 40, 256)


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, document index) of the lines of some texts; a text without any has one empty line."""
    doc_start = np.cumsum([0] + [len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    stops = np.flatnonzero(data == 10)
    starts = np.r_[0, stops[:-1] + 1]
    doc = np.searchsorted(doc_start, starts, "right") - 1
    kind = CLASS[data]
    # summed line by line, each with its end, which is white space
    counts = np.stack([np.add.reduceat(kind == k, starts, dtype=np.int64) for k in range(SPACE)], 1)
    visible = counts.sum(1)
    size = (stops - starts).astype(float)
    # words: from a byte that follows white space to the next white space; none goes over a line end
    solid = kind != SPACE
    edge = np.diff(np.r_[False, solid, False].astype(np.int8))
    ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word, symbols = np.zeros(len(ws), np.int64), np.zeros(len(ws), np.int64)
    for k in range(0, len(ws), WORDS_AT_ONCE):
        own = slice(k, k + WORDS_AT_ONCE)
        lo, hi = ws[own][0], we[own][-1] + 1  # white space follows the last word
        at = np.stack([ws[own], we[own]], 1).ravel() - lo
        word[own] = np.add.reduceat(CODE[data[lo:hi]], at)[::2]
        symbols[own] = np.add.reduceat(kind[lo:hi] == SYMBOL, at, dtype=np.int64)[::2]
    line_of_word = np.searchsorted(starts, ws, "right") - 1
    same = np.r_[False, (word[1:] == word[:-1]) & (line_of_word[1:] == line_of_word[:-1])]
    ends = kind[we - 1] == SYMBOL if len(we) else np.zeros(0, bool)
    only = symbols == we - ws
    capital = kind[ws] == UPPER if len(ws) else np.zeros(0, bool)
    n_lines = len(starts)
    words = np.bincount(line_of_word, minlength=n_lines).astype(float)
    per = lambda x: np.bincount(line_of_word, x, n_lines) / np.maximum(words, 1)
    seen = np.maximum(visible, 1)
    width = we - ws
    spread = per((np.r_[0, np.abs(np.diff(width))] > 0).astype(float))
    x = np.column_stack([np.log1p(size) / 5, *(counts[:, k] / seen for k in (UPPER, DIGIT, PUNCT, SYMBOL, HIGH)),
                         per(same), per(ends), per(only), np.minimum(per(width), 30) / 10, per(capital), spread])
    keep = visible > 0
    empty = np.setdiff1d(np.arange(len(texts)), doc[keep])
    keep[np.searchsorted(doc, empty)] = True
    return x[keep], visible[keep].astype(float), doc[keep]


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bias, own features, some of the lines before and after, and flags for first and last line."""
    new = np.r_[True, doc[1:] != doc[:-1]]
    last = np.r_[new[1:], True]
    before = np.where(new[:, None], 0, np.roll(x[:, NEAR], 1, 0))
    after = np.where(last[:, None], 0, np.roll(x[:, NEAR], -1, 0))
    return np.column_stack([np.ones(len(x)), x, before, after, new, last])


def _softplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(unary: np.ndarray, trans: np.ndarray, doc: np.ndarray):
    """(marginal of good per line, expected transitions summed, log Z per document); state 0 is bad, 1 good.

    Documents are stepped through together, longest first, so that those still going on are a prefix.
    """
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    sizes = np.diff(np.r_[starts, len(doc)])
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    n = len(doc)
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    emit = np.zeros((n, 2))
    emit[:, 1] = unary
    f[starts] = emit[starts]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] if len(sizes) else 0), "left")  # documents longer than t
    for t, m in enumerate(active, 1):
        at = starts[:m] + t
        prev = f[at - 1]
        f[at] = emit[at] + np.stack([_softplus(prev[:, 0] + trans[0, j], prev[:, 1] + trans[1, j]) for j in (0, 1)], 1)
    for t, m in reversed(list(enumerate(active, 1))):
        at = starts[:m] + t
        nxt = b[at] + emit[at]
        b[at - 1] = np.stack([_softplus(nxt[:, 0] + trans[i, 0], nxt[:, 1] + trans[i, 1]) for i in (0, 1)], 1)
    both = f + b
    log_z = _softplus(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - log_z)
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pair = f[at - 1][:, :, None] + trans + (emit[at] + b[at])[:, None, :] - log_z[at][:, None, None]
    return good, np.exp(pair).sum(0), log_z[np.sort(starts)]


@dataclass
class LineCRF:
    """Weights of the chain and of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def features(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, doc)

    def raw(self, x: np.ndarray, length: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Length-weighted mean marginal of "good" per document."""
        good, _, _ = forward_backward(self.features(x, doc) @ self.w, self.trans, doc)
        weight = length + 1e-9
        return np.bincount(doc, good * weight, n) / np.maximum(np.bincount(doc, weight, n), 1e-9)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -40, 40)))

    def score(self, texts: Iterable[str]) -> np.ndarray:
        out, held, size = [np.zeros(0)], [], 0
        for text in map(str.encode, texts):
            if held and size + len(text) >= BYTES:
                out.append(self._score(held))
                held, size = [], 0
            held.append(text)
            size += len(text)
        return np.concatenate([*out, self._score(held)]) if held else out[0]

    def _score(self, texts: list[bytes]) -> np.ndarray:
        x, length, doc = lines_of(texts)
        return self.calibrated(self.raw(x, length, doc, len(texts)))


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 250, rate: float = 0.08, decay: float = 1e-3) -> LineCRF:
    """Maximum likelihood with Adam on (features, lengths, label) per document, then the calibration.

    Without any document the result scores one half; with one label only, that label.
    """
    k = len(FEATURES)
    model = LineCRF(np.zeros(k), np.ones(k), np.zeros(3 + k + 2 * len(NEAR)), np.zeros((2, 2)))
    if not docs:
        return model
    x = np.concatenate([d[0] for d in docs])
    length = np.concatenate([d[1] for d in docs])
    doc = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    label = np.array([d[2] for d in docs], float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    phi, y = model.features(x, doc), label[doc]
    inner = np.r_[False, doc[1:] == doc[:-1]]
    gold = np.zeros((2, 2))
    for i in (0, 1):  # the label does not change within a document
        gold[i, i] = (inner & (y == i)).sum()
    theta = np.zeros(len(model.w) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        good, pairs, _ = forward_backward(phi @ theta[:-4], theta[-4:].reshape(2, 2), doc)
        grad = -np.r_[phi.T @ (y - good), (gold - pairs).ravel()] / len(docs) + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.w, model.trans = theta[:-4], theta[-4:].reshape(2, 2)
    raw = model.raw(x, length, doc, len(docs))
    z = np.column_stack([raw, np.ones(len(raw))])
    a = np.array([1.0, 0.0])
    target = label * 0.998 + 0.001
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ a, -40, 40)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        a = a + np.linalg.solve(h, z.T @ (target - p) - 1e-2 * a)
    model.slope, model.offset = a
    return model


# ---- learning from blocks of lines ----

@dataclass
class Lines:
    """Documents, longest first, line by line: all first lines, all second ones, and so on; ``x`` is standardised."""

    x: np.ndarray
    length: np.ndarray
    label: np.ndarray
    active: np.ndarray

    @staticmethod
    def of(docs: list[tuple[np.ndarray, np.ndarray, int]], mean: np.ndarray, scale: np.ndarray) -> "Lines":
        sizes = np.array([len(d[0]) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        at = np.concatenate([starts[:m] + t for t, m in enumerate(active)])
        x, length = (np.concatenate([d[k] for d in docs])[at] for k in (0, 1))
        return Lines((x - mean) / scale, length, np.array([d[2] for d in docs], float)[order], active)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The document of each line, the lines that are not first, and those before them."""
        inner = np.arange(self.active[0], len(self.x))
        doc = np.arange(len(self.x)) - np.repeat(np.cumsum(self.active) - self.active, self.active)
        return doc, inner, inner - np.repeat(self.active[:-1], self.active[1:])

    def _parts(self, w: np.ndarray) -> list[np.ndarray]:
        """The weights of the bias, own features, those of the lines before and after, and of first and last lines."""
        return np.split(w, np.cumsum([1, len(FEATURES), len(NEAR), len(NEAR), 1]))

    def marginals(self, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The marginal of "good" per line, and expected transitions summed."""
        bias, own, before, after, new, last = self._parts(w)
        doc, inner, ahead = self.places()
        unary = bias + self.x @ own
        unary[inner] += (self.x[:, NEAR] @ before)[ahead]
        unary[ahead] += (self.x[:, NEAR] @ after)[inner]
        unary[:self.active[0]] += new
        end = np.ones(len(unary), bool)
        end[ahead] = False
        unary[end] += last
        _, good, pairs = chain_sums(np.stack([np.zeros(len(unary)), unary], 1), trans, self.active)
        return good[:, 1], pairs

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        """Of the log-likelihood, with respect to weights and transitions."""
        good, pairs = self.marginals(theta[:-4], theta[-4:].reshape(2, 2))
        doc, inner, ahead = self.places()
        off, near = self.label[doc] - good, self.x[:, NEAR]
        end = np.ones(len(off), bool)
        end[ahead] = False
        same = np.bincount(self.label[doc[inner]].astype(int), minlength=2)  # the label does not change within a document
        return np.r_[off.sum(), self.x.T @ off, near[ahead].T @ off[inner], near[inner].T @ off[ahead], off[:self.active[0]].sum(), off[end].sum(),
                     (np.diag(same) - pairs).ravel()]

    def raw(self, w: np.ndarray, trans: np.ndarray) -> np.ndarray:
        """As ``LineCRF.raw``."""
        good, (doc, _, _), weight, n = self.marginals(w, trans)[0], self.places(), self.length + 1e-9, len(self.label)
        return np.bincount(doc, good * weight, n) / np.maximum(np.bincount(doc, weight, n), 1e-9)


def _documents(batch: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    return [(np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)).astype(float), np.frombuffer(n, np.float32).astype(float), label)
            for x, n, label in zip(batch["x"], batch["length"], batch["label"])]


def reduced(rows: DataFrame, sums: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """``sums`` of all batches added up: one job, a short row per partition, added in their order."""
    def run(batches):
        total = sum(map(sums, batches))
        if not isinstance(total, int):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [total.tobytes()]})

    parts = sorted((r["part"], bytes(r["sums"])) for r in rows.mapInPandas(run, "part int, sums binary").collect())
    return sum(np.frombuffer(p) for _, p in parts)


def fit_table(table: DataFrame, lines: int, steps: int = 250, rate: float = 0.08, decay: float = 1e-3) -> LineCRF:
    """As ``fit``, of a written table (x, length, label, lines) with a row per document and so many lines in all."""
    k = len(FEATURES)
    model = LineCRF(np.zeros(k), np.ones(k), np.zeros(3 + k + 2 * len(NEAR)), np.zeros((2, 2)))
    if lines <= DRIVER_LINES:
        few = table.toPandas()
        over = lambda sums: sum(sums(few.iloc[k:k + 1000]) for k in range(0, len(few), 1000))
    else:
        over = lambda sums: reduced(table, sums)
    model.mean = over(lambda batch: sum(d[0].sum(0) for d in _documents(batch))) / lines
    mean = model.mean
    model.scale = np.sqrt(over(lambda batch: sum(((d[0] - mean) ** 2).sum(0) for d in _documents(batch))) / lines) + 1e-3
    scale, n = model.scale, table.count()

    def made(batches):
        held, size = [], 0
        for batch in batches:
            for d in _documents(batch):
                held.append(d)
                size += len(d[0])
                if size >= BLOCK_LINES:
                    yield pd.DataFrame({"block": [pickle.dumps(Lines.of(held, mean, scale), 5)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"block": [pickle.dumps(Lines.of(held, mean, scale), 5)]})

    if lines <= DRIVER_LINES:
        held = [pickle.loads(b) for part in made(few.iloc[k:k + 1000] for k in range(0, len(few), 1000)) for b in part["block"]]
        del few
        summed = lambda sums: sum(map(sums, held))
    else:
        # written, so that no task of a step runs two workers
        blocks = as_table(table.repartition(-(-lines // BLOCK_LINES)).mapInPandas(made, "block binary"), "quality-blocks").persist(StorageLevel.MEMORY_AND_DISK)
        summed = lambda sums: reduced(blocks, lambda batch: sum(sums(pickle.loads(b)) for b in batch["block"]))
    theta = np.zeros(len(model.w) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        at = theta.copy()
        grad = -summed(lambda block, at=at: block.gradient(at)) / n + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.w, model.trans = theta[:-4], theta[-4:].reshape(2, 2)
    w, trans = model.w, model.trans

    def scored(batches):
        for batch in batches:
            for b in map(pickle.loads, batch["block"]):
                yield pd.DataFrame({"raw": [b.raw(w, trans).tobytes()], "label": [b.label.tobytes()]})

    if lines <= DRIVER_LINES:
        raw = pd.DataFrame({"raw": [b.raw(w, trans).tobytes() for b in held], "label": [b.label.tobytes() for b in held]})
        over = lambda sums: sums(raw)
    else:
        raw = as_table(blocks.mapInPandas(scored, "raw binary, label binary"), "quality-raw")
        blocks.unpersist()
        over = lambda sums: reduced(raw, sums)
    a = np.array([1.0, 0.0])

    def newton(batch: pd.DataFrame, a: np.ndarray) -> np.ndarray:
        r, label = (np.frombuffer(b"".join(batch[c])) for c in ("raw", "label"))
        z, target = np.column_stack([r, np.ones(len(r))]), label * 0.998 + 0.001
        p = 1 / (1 + np.exp(-np.clip(z @ a, -40, 40)))
        return np.r_[((z * (p * (1 - p))[:, None]).T @ z).ravel(), z.T @ (target - p)]

    for _ in range(50):
        sums = over(lambda batch, a=a: newton(batch, a))
        step = np.linalg.solve(sums[:4].reshape(2, 2) + 1e-2 * np.eye(2), sums[4:] - 1e-2 * a)
        a = a + step
        if np.abs(step).max() < 1e-12:
            break
    model.slope, model.offset = a
    return model


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that nothing is learnt from; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def stretch(lines: int, size: int, draw: int) -> slice:
    """The lines that are learnt from: all, or of a longer document ``size`` that follow each other, so that neighbours are neighbours."""
    start = draw % (lines - size + 1) if lines > size else 0
    return slice(start, start + min(lines, size))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int | None = None,
          sample_lines: int | None = None) -> LineCRF:
    """Fit on all labelled documents outside the held-out fold; a caller may bound them and their lines."""
    known = labels.where(labels.doc_id.isNotNull() & labels.quality.isNotNull() & ~held_out(labels.doc_id)).groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("label"))
    if sample_docs is not None:  # drawn from the small label table, before any text is read
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    known = as_table(known, "quality-labels")
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    rows = lookup_join(source, known, ["doc_id"], "inner", small_fits=fits_broadcast(known))

    def run(batches):
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"]):
                x, length, _ = lines_of([(text or "").encode()])
                if sample_lines is not None:
                    at = stretch(len(x), sample_lines, zlib.crc32((text or "").encode()))
                    x, length = x[at], length[at]
                out.append((x.astype(np.float32).ravel().tobytes(), length.astype(np.float32).tobytes(), int(label), len(x)))
            yield pd.DataFrame(out, columns=["x", "length", "label", "lines"])

    table = as_table(rows.mapInPandas(run, "x binary, length binary, label int, lines int"), "quality-lines")
    lines = table.agg(F.sum("lines")).first()[0] or 0
    if lines > LOCAL_LINES:
        return fit_table(table, lines)
    few = sorted(table.collect(), key=lambda r: (bytes(r["x"]), r["label"]))
    return fit(_documents(pd.DataFrame([r.asDict() for r in few], columns=table.columns)))


def score(docs: DataFrame, model: LineCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from the whole text.

    Null and empty texts, and those of white space only, are scored as one empty line. Null ids and repeated
    rows stay; further columns are ignored; an empty table gives an empty result. A narrow map.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def run(batches):
        for batch in batches:
            s = shared.value.score(batch["text"].fillna(""))
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "score": s})

    source = docs.select(docs[id_col].cast("bigint").cast("string").alias("doc_id"), docs[text_col].alias("text"))
    scored = exact_id(source.mapInPandas(run, "doc_id string, score double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the classifier rejects, texts scored in place: no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(text.fillna("")))

    return docs.where(quality(F.col(text_col)) >= THRESHOLD)
