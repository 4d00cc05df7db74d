"""Splits, folds and counts for leakage-free features.

Order comes from md5 of seed and id. Ranks are exact and computed without sorting a
category in one task (``exact_rank``), because one category may hold most sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.plans.scale import exact_rank, seeded_hash

SEED = 42
TRAIN_RATIO, DEV_RATIO = 0.8, 0.1
FOLDS = 5
DEV_IN_TRAIN = 0.111
DEV_SEED_STEP = 1000


def _ranked(keys: DataFrame, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    return exact_rank(keys.withColumn("_h", seeded_hash(seed, "sid")), "_h", "sid", by=by).drop("_h")


def random_split(sent: DataFrame, seed: int = SEED, train: float = TRAIN_RATIO, dev: float = DEV_RATIO) -> DataFrame:
    """(sid, split): sizes by integer truncation, the rest is test."""
    r = _ranked(sent.select("sid"), seed)
    n_train = F.floor(F.col("n") * F.lit(train))
    n_dev = F.floor(F.col("n") * F.lit(dev))
    return r.select("sid", F.when(F.col("rank") < n_train, "train")
                    .when(F.col("rank") < n_train + n_dev, "dev").otherwise("test").alias("split"))


def stratified_split(sent: DataFrame, seed: int = SEED, train: float = TRAIN_RATIO,
                     dev: float = DEV_RATIO) -> DataFrame:
    """(sid, category, split): per category at least one train and one dev sentence; a category
    too small for a test sentence goes to train whole."""
    r = _ranked(sent.select("sid", "category"), seed, by=("category",))
    n_train = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(train)))
    n_dev = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(dev)))
    small = F.col("n") - n_train - n_dev < 1
    return r.select("sid", "category", F.when(small | (F.col("rank") < n_train), "train")
                    .when(F.col("rank") < n_train + n_dev, "dev").otherwise("test").alias("split"))


def _fold_of(rank: Column, n: Column, k: int) -> Column:
    """The fold whose bounds round(i*n/k), half to even, enclose the rank."""
    passed = [F.when(rank >= F.bround(F.lit(float(i)) * n / F.lit(float(k)), 0), 1).otherwise(0) for i in range(1, k)]
    fold = F.lit(0)
    for p in passed:
        fold = fold + p
    return fold.cast("int")


def kfold(sent: DataFrame, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """(sid, fold) by consecutive slices of the shuffled order."""
    r = _ranked(sent.select("sid"), seed)
    return r.select("sid", _fold_of(F.col("rank"), F.col("n"), k).alias("fold"))


def stratified_kfold(sent: DataFrame, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """(sid, category, fold): as ``kfold``, inside every category."""
    r = _ranked(sent.select("sid", "category"), seed, by=("category",))
    return r.select("sid", "category", _fold_of(F.col("rank"), F.col("n"), k).alias("fold"))


def fold_roles(folds: DataFrame, k: int = FOLDS, seed: int = SEED, dev: float = DEV_IN_TRAIN) -> DataFrame:
    """(sid, run, role): in run i fold i is test; the first max(1, int(dev * pool)) of the pool,
    shuffled with seed + 1000 + i, is dev; the rest is train."""
    runs = folds.select("sid", "fold", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("run"))
    test = runs.where(F.col("run") == F.col("fold")).select("sid", "run", F.lit("test").alias("role"))
    pool = runs.where(F.col("run") != F.col("fold")).select(
        "sid", "run", F.md5(F.concat_ws("|", (F.col("run") + (seed + DEV_SEED_STEP)).cast("string"),
                                        F.col("sid").cast("string"))).alias("_h"))
    ranked = exact_rank(pool, "_h", "sid", by=("run",))
    n_dev = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(dev)))
    rest = ranked.select("sid", "run", F.when(F.col("rank") < n_dev, "dev").otherwise("train").alias("role"))
    return test.unionByName(rest)


def with_fold_roles(sent: DataFrame, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """``sent`` plus ``fold`` (its test run) and ``in_train``, an array of k booleans."""
    folds = stratified_kfold(sent, k, seed)
    roles = fold_roles(folds, k, seed).groupBy("sid").agg(
        F.max(F.when(F.col("role") == "test", F.col("run"))).alias("fold"),
        F.array(*[F.max((F.col("run") == i) & (F.col("role") == "train")) for i in range(k)]).alias("in_train"))
    return sent.join(roles, "sid")


def group_split(records: DataFrame, group: str, n_valid: int = 5, seed: int = SEED) -> DataFrame:
    """(group, split): the first ``n_valid`` groups in hash order are valid; at most that many rows are broadcast."""
    groups = records.select(group).distinct()
    valid = groups.withColumn("_h", seeded_hash(seed, group)).orderBy("_h", group).limit(n_valid).select(
        group, F.lit("valid").alias("_v"))
    return groups.join(F.broadcast(valid), group, "left").select(group, F.coalesce("_v", F.lit("train")).alias("split"))


def inner_folds(sent: DataFrame, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """(sid, fold) dealt round-robin: shuffled rank modulo k, as used for out-of-fold features."""
    r = _ranked(sent.select("sid"), seed)
    return r.select("sid", F.pmod("rank", F.lit(k)).cast("int").alias("fold"))


def per_fold(value: Column, fold: Column, k: int = FOLDS) -> Column:
    """Aggregate: array of k sums of ``value``, one for each fold."""
    return F.array(*[F.coalesce(F.sum(F.when(fold == i, value)), F.lit(0)) for i in range(k)])


def has_own_ids(dataset: DataFrame) -> bool:
    """Whether no two rows share a ``sid``."""
    return dataset.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def others(counts: Column, fold: Column) -> Column:
    """The sum over all folds but one: leaving a fold out is a subtraction, not another scan."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return total - F.element_at(counts, fold + 1)
