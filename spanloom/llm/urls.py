"""URL filter: rules first, then the ratio of two character language models.

Two smoothed variable-order Markov models are learnt from the URLs that the rules accept and reject: counts of
every symbol after its last zero to three symbols, interpolated from the shortest context to the longest by
Witten and Bell's rule. A URL without a rule is judged by its length-normalised log-likelihood difference,
against a threshold calibrated on ruled URLs that were kept out of the counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host/path), production rules.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Symbols of the models; capital letters count as small ones, digits as 0, anything else as "~".
ALPHABET = "^$~0abcdefghijklmnopqrstuvwxyz./-_?=&#:%+"
ORDER = 3
FOLDS, BINS, RANGE = 5, 2048, 8.0


def url_host(url: Column) -> Column:
    """Between the first "://" and the next "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, nulls if none; of equally long ones the first listed."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def spelled(url: Column) -> Column:
    """The URL in the models' symbols, with start and end marks."""
    text = F.lower(F.coalesce(url, F.lit("")))
    kept = "".join("\\" + c if c in "-^$~[]\\" else c for c in ALPHABET if c not in "^$~0") + "0-9"
    text = F.regexp_replace(text, f"(?s)[^{kept}]", "~")
    return F.concat(F.lit("^" * ORDER), F.translate(text, "123456789", "000000000"), F.lit("$"))


def gram_counts(ruled: DataFrame) -> DataFrame:
    """(verdict, gram, n) of (verdict, s): all windows of ORDER + 1 symbols, counted with map-side combination.

    There are at most 2 * 41 ** 4 rows, whatever the input.
    """
    grams = ruled.select("verdict", F.explode(F.expr(f"transform(sequence(1, length(s) - {ORDER}), i -> substring(s, i, {ORDER + 1}))")).alias("gram"))
    return grams.groupBy("verdict", "gram").agg(F.count(F.lit(1)).alias("n"))


def symbol_ids(text: bytes) -> np.ndarray:
    table = np.full(256, ALPHABET.index("~"), np.int64)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i
    return table[np.frombuffer(text, np.uint8)]


def log_probabilities(grams: list[str], counts: np.ndarray) -> np.ndarray:
    """Log probability of the last symbol of each gram, flat over all |ALPHABET| ** (ORDER + 1) grams."""
    v = len(ALPHABET)
    full = np.zeros(v ** (ORDER + 1))
    if len(grams):
        ids = symbol_ids("".join(grams).encode()).reshape(len(grams), ORDER + 1)
        np.add.at(full, ids @ v ** np.arange(ORDER, -1, -1), counts)
    prob = np.full((1, v), 1.0 / v)
    for order in range(ORDER + 1):
        c = full.reshape(-1, v ** (order + 1)).sum(0).reshape(-1, v)
        total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        shorter = np.tile(prob, (len(c) // len(prob), 1))
        prob = np.where(total > 0, (c + kinds * shorter) / np.maximum(total + kinds, 1), shorter)
    return np.log(prob).ravel()


def llr_scores(texts: list[str], ratio: np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference per symbol of spelled URLs."""
    if not texts:
        return np.zeros(0)
    v = len(ALPHABET)
    flat = "".join(texts).encode()
    ids = symbol_ids(flat)
    gram = np.zeros(len(ids) - ORDER, np.int64)
    for k in range(ORDER + 1):
        gram = gram * v + ids[k:len(ids) - ORDER + k]
    total = np.r_[0, np.cumsum(ratio[gram], dtype=np.float64)]
    ends = np.cumsum([len(t) for t in texts])
    starts = np.r_[0, ends[:-1]]
    last = ends - ORDER
    return (total[last] - total[starts]) / (last - starts)


def calibrate(bins: list[int], allow: list[int], block: list[int]) -> float:
    """Lower edge of the bin from which on URLs are allowed, with the best mean recall of both verdicts; 0 without data."""
    a, b = np.zeros(BINS), np.zeros(BINS)
    a[bins], b[bins] = allow, block
    if not a.sum() or not b.sum():
        return 0.0
    recall = (np.r_[np.cumsum(a[::-1])[::-1], 0] / a.sum() + np.r_[0, np.cumsum(b)] / b.sum()) / 2
    best = np.flatnonzero(recall >= recall.max() - 1e-12)
    # of equally good edges the middle of the first stretch, so that the margin is even
    stretch = best[: int(np.argmax(np.r_[np.diff(best) > 1, True])) + 1]
    return float(stretch[len(stretch) // 2] / BINS * 2 * RANGE - RANGE)


def _bin(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((score + RANGE) / (2 * RANGE) * BINS))).cast("int")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, score, verdict for every row.

    Null URLs and those without "://" have empty host and path; they, and all others without a rule, are judged by
    the model. With rules of one verdict only, or no ruled URL at all, scores of at least zero are allowed. Null ids
    and repeated rows stay; further columns are ignored; an empty table gives an empty result. Counts come from
    all ruled URLs outside one hashed fold, and are combined before they are shuffled.
    """
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].alias("url"))
    rows = rows.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), spelled(F.col("url")).alias("s"))
    rows = rows.withColumn("m", match_rules(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "s", "m.rule", "m.verdict")
    ruled = rows.where("rule is not null").withColumn("out", F.crc32(F.col("s").cast("binary")) % FOLDS == 0)
    counted = gram_counts(ruled.where("not out")).collect()  # bounded by the alphabet
    logs = {}
    for side in ("allow", "block"):
        own = [r for r in counted if r["verdict"] == side]
        logs[side] = log_probabilities([r["gram"] for r in own], np.array([r["n"] for r in own], float))
    shared = spark.sparkContext.broadcast((logs["allow"] - logs["block"]).astype(np.float32))  # 41 ** 4 numbers: 11 MB

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(llr_scores(s.tolist(), shared.value), dtype="float64")

    scored = rows.withColumn("score", score("s"))
    held = ruled.where("out").withColumn("score", score("s")).groupBy(_bin(F.col("score")).alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")).collect()  # at most BINS rows
    edge = calibrate([r["bin"] for r in held], [r["a"] for r in held], [r["b"] for r in held])
    verdict = F.coalesce("verdict", F.when(F.col("score") >= edge, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select("page_id", "host", "path", "rule", "score", verdict.alias("verdict"))
