"""Personal data: fixed patterns, and spans added by a character-level BiLSTM with CRF transitions.

The network is trained in numpy on windows around digits and "@", with the pattern matches of a bounded sample as
labels. At inference every stretch of text near such a character is covered by overlapping windows; each window
is decoded into emissions, emissions of overlapping windows are averaged with weights that fall towards the
window's ends, and one Viterbi pass over the whole stretch reconciles them globally. Every kind needs a digit
or "@", so text without one cannot hold a span and is not run through the network.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import exact_id

KINDS = ["email", "ip", "card", "phone"]
#: Shortest possible match of each kind; shorter decoded spans are no candidates.
SHORTEST = {"email": 5, "ip": 7, "card": 14, "phone": 11}
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
WINDOW, STRIDE, REACH = 64, 32, 24
#: The network learns from about so many documents with a digit or "@", and from so many windows at most.
SAMPLE_DOCS, DOC_WINDOWS, SAMPLE_WINDOWS = 1500, 20, 1600
HIDDEN, EMBED = 12, 8
#: 0 padding, 1 other letter, 2 other character, then printable ASCII.
VOCAB = 3 + 95
BATCH = 4096

# The patterns of the base spans.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match at a later digit of a run would have matched at the run's first digit: the look-behind only saves time.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    """Luhn's check sum: every second digit from the right doubled, digit sums added, divisible by ten."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches around each "@" in turn: the local part can hold none, so it is the run of its characters before."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, by start and then by kind as listed."""
    if not TRIGGER.search(text):
        return []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(s, e, 0) for s, e in _emails(text)]
    found += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    found += [(*m.span(), 2) for m in CARD.finditer(text) if 14 <= len(d := digits(m)) <= 19 and luhn(d)]
    if "+" in text:
        found += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def char_ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((code >= 32) & (code < 127), code.astype(np.int64) - 29, np.where(code > 127, 1, 2))


def tags_of(spans, lo: int, hi: int) -> np.ndarray:
    """Tag ids of text[lo:hi]; of overlapping spans the earlier one counts."""
    tags = np.zeros(hi - lo, np.int8)
    for s, e, kind in reversed(spans):
        if s < hi and e > lo:
            b = 1 + 2 * KINDS.index(kind)
            tags[max(s, lo) - lo:min(e, hi) - lo] = b + 1
            if s >= lo:
                tags[s - lo] = b
    return tags


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def legal() -> np.ndarray:
    """-1e4 where a tag may not follow another: I only after B or I of its kind."""
    out = np.zeros((len(TAGS), len(TAGS)), np.float32)
    for j, b in enumerate(TAGS):
        if b[0] == "I":
            for i, a in enumerate(TAGS):
                out[i, j] = 0 if a[1:] == b[1:] else -1e4
    return out


@dataclass
class Tagger:
    """Parameters: embedding, per direction (input, recurrent, bias), output, transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 3) -> Tagger:
        r = np.random.default_rng(seed)
        k = len(TAGS)
        g = lambda *s, by: r.normal(0, 1 / np.sqrt(by), s).astype(np.float32)
        p = {"emb": g(VOCAB, EMBED, by=EMBED), "out": g(2 * HIDDEN, k, by=2 * HIDDEN), "bias": np.zeros(k, np.float32), "trans": np.zeros((k, k), np.float32)}
        for d in "fb":
            p |= {f"w{d}": g(EMBED, 4 * HIDDEN, by=EMBED), f"u{d}": g(HIDDEN, 4 * HIDDEN, by=HIDDEN), f"b{d}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}
        return cls(p)

    def _direction(self, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H); gates in the order input, forget, output, candidate. ids is (T, B)."""
        p, (t_max, b) = self.p, ids.shape
        table = p["emb"] @ p[f"w{d}"] + p[f"b{d}"]
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        out = np.zeros((t_max, b, HIDDEN), np.float32)
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            z = table[ids[t]] + h @ p[f"u{d}"]
            gate, cand = _sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
            c_old, h_old = c, h
            c = f * c + i * cand
            tc = np.tanh(c)
            h = o * tc
            live = (ids[t] > 0)[:, None]
            c, h = np.where(live, c, 0), np.where(live, h, 0)
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, cand, c_old, h_old, tc, live))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(T, B, tags) for windows as columns."""
        h = np.concatenate([self._direction(ids, "f"), self._direction(ids, "b")], 2)
        return h @ self.p["out"] + self.p["bias"]

    def gradient(self, ids: np.ndarray, gold: np.ndarray):
        """Loss per window and gradients of the CRF likelihood."""
        p, keeps = self.p, {"f": [], "b": []}
        h = np.concatenate([self._direction(ids, d, keeps[d]) for d in "fb"], 2)
        e = h @ p["out"] + p["bias"]
        trans = p["trans"] + legal()
        t_max, b, k = e.shape
        live = ids > 0
        size = live.sum(0)
        lse = lambda x, ax: (m := x.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(x - m).sum(ax))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, t_max):
            alpha[t] = np.where(live[t][:, None], e[t] + lse(alpha[t - 1][:, :, None] + trans, 1), alpha[t - 1])
        for t in range(t_max - 2, -1, -1):
            beta[t] = np.where(live[t + 1][:, None], lse(trans + (beta[t + 1] + e[t + 1])[:, None, :], 2), 0)
        log_z = lse(alpha[-1], 1)
        col = np.arange(b)
        de = np.exp(np.minimum(alpha + beta - log_z[:, None], 0)) * live[:, :, None]
        gold_score = np.zeros(b, np.float32)
        dtrans = np.zeros_like(trans)
        for t in range(t_max):
            on = live[t]
            gold_score += np.where(on, e[t, col, gold[t]], 0)
            de[t, col[on], gold[t][on]] -= 1
            if t:
                gold_score += np.where(on, trans[gold[t - 1], gold[t]], 0)
                np.add.at(dtrans, (gold[t - 1][on], gold[t][on]), -1)
                dtrans += np.exp(np.minimum(alpha[t - 1][on][:, :, None] + trans + (e[t] + beta[t])[on][:, None, :] - log_z[on][:, None, None], 0)).sum(0)
        g = {"trans": dtrans, "out": np.einsum("tbh,tbk->hk", h, de), "bias": de.sum((0, 1)), "emb": np.zeros_like(p["emb"])}
        dh_all = de @ p["out"].T
        for d, part in (("f", dh_all[:, :, :HIDDEN]), ("b", dh_all[:, :, HIDDEN:])):
            dz_all = np.zeros((t_max, b, 4 * HIDDEN), np.float32)
            du = np.zeros_like(p[f"u{d}"])
            dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
            for t, i, f, o, cand, c_old, h_old, tc, on in reversed(keeps[d]):
                dh, dc = (dh + part[t]) * on, dc * on
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * cand * i * (1 - i), dc * c_old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)], 1)
                dz_all[t] = dz
                du += h_old.T @ dz
                dh, dc = dz @ p[f"u{d}"].T, dc * f
            by_char = np.zeros((VOCAB, 4 * HIDDEN), np.float32)
            np.add.at(by_char, ids.ravel(), dz_all.reshape(-1, 4 * HIDDEN))
            by_char[0] = 0
            g |= {f"u{d}": du, f"b{d}": by_char.sum(0), f"w{d}": p["emb"].T @ by_char}
            g["emb"] += by_char @ p[f"w{d}"].T
        del size
        return float((log_z - gold_score).mean()), {n: x / b for n, x in g.items()}

    def stretch_tags(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """Tags of each stretch: windows, averaged emissions, one Viterbi pass."""
        windows, owner = [], []
        for i, s in enumerate(stretches):
            for lo in range(0, max(1, len(s) - WINDOW + STRIDE), STRIDE):
                windows.append(s[lo:lo + WINDOW])
                owner.append((i, lo))
        total = [np.zeros((len(s), len(TAGS)), np.float32) for s in stretches]
        weight = [np.zeros((len(s), 1), np.float32) for s in stretches]
        for k in range(0, len(windows), BATCH):
            part = windows[k:k + BATCH]
            ids = np.zeros((max(map(len, part)), len(part)), np.int64)
            for j, w in enumerate(part):
                ids[:len(w), j] = w
            e = self.emissions(ids)
            for j, w in enumerate(part):
                i, lo = owner[k + j]
                n = len(w)
                tri = np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)).astype(np.float32)[:, None]
                total[i][lo:lo + n] += e[:n, j] * tri
                weight[i][lo:lo + n] += tri
        return self._viterbi([t / w for t, w in zip(total, weight)])

    def _viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        trans = self.p["trans"] + legal()
        start = np.array([-1e4 if t[0] == "I" else 0 for t in TAGS], np.float32)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        lo = 0
        while lo < len(order):  # stretches of similar length together, about BATCH * WINDOW positions at a time
            n = max(1, min(len(order) - lo, BATCH * WINDOW // max(1, len(scores[order[lo]]))))
            group = order[lo:lo + n]
            lo += n
            sizes = np.array([len(scores[i]) for i in group])
            best = np.stack([scores[i][0] for i in group]) + start
            back = np.zeros((sizes[0], n, len(TAGS)), np.int8)
            for t in range(1, sizes[0]):
                m = int((sizes > t).sum())
                step = best[:m, :, None] + trans
                back[t, :m] = step.argmax(1)
                best[:m] = step.max(1) + np.stack([scores[i][t] for i in group[:m]])
            for j, i in enumerate(group):
                tag = int(best[j].argmax())
                path = np.zeros(sizes[j], np.int64)
                for t in range(sizes[j] - 1, -1, -1):
                    path[t] = tag
                    tag = int(back[t, j, tag])
                out[i] = path
        return out


def spans_of(tags: np.ndarray, offset: int) -> list[tuple[int, int, str]]:
    out = []
    for i, t in enumerate(tags):
        if t and t % 2 == 1:
            out.append([offset + i, offset + i + 1, KINDS[(t - 1) // 2]])
        elif t and out and out[-1][1] == offset + i:
            out[-1][1] = offset + i + 1
    return [tuple(x) for x in out]


def stretches_of(text: str) -> list[tuple[int, int]]:
    """Where the network reads: REACH characters around every digit and "@", merged."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def added_spans(texts: list[str], bases: list[list], model: Tagger) -> list[list[tuple[int, int, str]]]:
    """Spans of the network that no base span overlaps, long enough for their kind and with a digit or "@"."""
    where = [(i, lo, hi) for i, t in enumerate(texts) for lo, hi in stretches_of(t)]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k in range(0, len(where), BATCH):
        part = where[k:k + BATCH]
        for (i, lo, _), tags in zip(part, model.stretch_tags([char_ids(texts[i][lo:hi]) for i, lo, hi in part])):
            taken = np.zeros(len(tags), bool)
            for s, e, _k in bases[i]:
                taken[max(0, s - lo):max(0, e - lo)] = True
            for s, e, kind in spans_of(tags, lo):
                if not taken[s - lo:e - lo].any() and e - s >= SHORTEST[kind] and TRIGGER.search(texts[i], s, e):
                    out[i].append((s, e, kind))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def fit(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = 350, batch: int = 64, rate: float = 0.02, seed: int = 3) -> Tagger:
    """Adam on (character ids, tags) windows of WINDOW characters at most; without any, nothing is tagged."""
    model = Tagger.new(seed)
    if not windows:
        model.p["bias"][0] = 1e3
        return model
    ids = np.zeros((WINDOW, len(windows)), np.int64)
    gold = np.zeros((WINDOW, len(windows)), np.int64)
    for j, (x, y) in enumerate(windows):
        ids[:len(x), j], gold[:len(x), j] = x, y
        if y[0] and y[0] % 2 == 0:  # the window cuts into a span: it begins here
            cut = int(np.argmax(np.r_[y != y[0], True]))
            gold[0, j] = y[0] - 1 if cut else 0
    rng = np.random.default_rng(seed)
    m = {n: np.zeros_like(x) for n, x in model.p.items()}
    v = {n: np.zeros_like(x) for n, x in model.p.items()}
    t = 0
    while t < steps:
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            t += 1
            _, g = model.gradient(ids[:, at], gold[:, at])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for n in model.p:
                x = g[n] * min(1, 5 / (norm + 1e-9))
                m[n] = 0.9 * m[n] + 0.1 * x
                v[n] = 0.99 * v[n] + 0.01 * x * x
                step = rate * max(0.0, 1 - t / steps) + 1e-4
                model.p[n] = (model.p[n] - step * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


def windows_of(text: str) -> list[tuple[str, np.ndarray]]:
    """Training windows: each base span and each stretch without one, at a place hashed from the text."""
    spans = base_spans(text)
    out = []
    for lo, hi in stretches_of(text):
        inside = [s for s in spans if s[0] < hi and s[1] > lo]
        for s in inside or [(lo, hi, "")]:
            shift = int(hashlib.md5(text[s[0]:s[1]].encode()).hexdigest()[:6], 16) % STRIDE
            a = max(0, (s[0] + s[1]) // 2 - WINDOW // 2 - STRIDE // 2 + shift)
            part = text[a:a + WINDOW]
            if part:
                out.append((part, tags_of(spans, a, a + len(part))))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_WINDOWS, sample_docs: int = SAMPLE_DOCS) -> Tagger:
    """Labelled windows of a sample of the documents with a digit or "@".

    The sample is a hashed share of them, so that it and what reaches the driver have the same size for any input.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = [(part, tags.tobytes(), hashlib.md5(part.encode()).hexdigest()) for part, tags in windows_of(text)]
                rows += sorted(found, key=lambda r: (r[2], r[1]))[:DOC_WINDOWS]
            yield pd.DataFrame(sorted(rows, key=lambda r: (r[2], r[1]))[:sample], columns=["part", "tags", "h"])

    near = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, sample_docs / max(1, near.count()))
    drawn = near.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = drawn.select("text").mapInPandas(run, "part string, tags binary, h string").orderBy("h", "tags").limit(sample).collect()
    return fit([(char_ids(r["part"]), np.frombuffer(r["tags"], np.int8).astype(np.int64)) for r in found])


def find(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), n_added, base_sha256, spans for every row.

    Offsets are code points of the whole text, ends exclusive. Null and empty texts have no spans. Null ids
    and repeated rows stay; further columns are ignored; an empty table gives an empty result. A narrow map.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "n_added", "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            bases = [base_spans(t) for t in texts]
            added = added_spans(texts, bases, shared.value)
            rows = []
            for base, more in zip(bases, added):
                every = sorted([*base, *more], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
                rows.append([*[sum(x[2] == k for x in base) for k in KINDS], len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)])
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    source = docs.select(docs[id_col].cast("bigint").cast("string").alias("doc_id"), docs[text_col].alias("text"))
    schema = "doc_id string, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base_sha256 string, spans string"
    return exact_id(source.mapInPandas(run, schema))
