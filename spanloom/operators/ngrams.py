"""Statistics of unlabelled text: characters, adjacent pairs, association and adjacency entropy.

Runs are reduced to pair counts before anything else happens: pairs are formed inside
the row, counted with map-side combination, and every later step works on the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.script import characters
from spanloom.session import as_table
from spanloom.sources.versions import commit, folder_of, has_batch, newest

DPMI_DISCOUNT = 0.5
METRICS = ("dpmi", "dice", "t_score")


def unigrams(runs: DataFrame, run: str = "run") -> DataFrame:
    return runs.select(F.explode(characters(F.col(run))).alias("ch")).groupBy("ch").agg(
        F.count(F.lit(1)).alias("cnt"))


def bigrams(runs: DataFrame, run: str = "run") -> DataFrame:
    """(a, b, cnt): adjacent characters, never across runs."""
    chars = characters(F.col(run))
    n = F.size(chars)
    pairs = F.arrays_zip(F.slice(chars, F.lit(1), n - 1).alias("a"), F.slice(chars, F.lit(2), n - 1).alias("b"))
    return runs.where(F.length(run) >= 2).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(
        F.count(F.lit(1)).alias("cnt"))


def adjacency(bi: DataFrame) -> DataFrame:
    """(a, b, cnt, p_next, p_prev): share of b among successors of a, and of a among predecessors of b.

    The totals are aggregates joined back, not windows: a window would sort all
    neighbours of a frequent character in one task.
    """
    after = bi.groupBy("a").agg(F.sum("cnt").alias("n_after"))
    before = bi.groupBy("b").agg(F.sum("cnt").alias("n_before"))
    return bi.join(after, "a").join(before, "b").select(
        "a", "b", "cnt", (F.col("cnt") / F.col("n_after")).alias("p_next"),
        (F.col("cnt") / F.col("n_before")).alias("p_prev"))


def log_freq(cnt: Column) -> Column:
    return F.log(1 + cnt)


def with_margins(bi: DataFrame, uni: DataFrame) -> DataFrame:
    """Pair counts with c_a, c_b (unigram counts, 1 if absent) and N (all pairs)."""
    a = uni.select(F.col("ch").alias("a"), F.col("cnt").alias("c_a"))
    b = uni.select(F.col("ch").alias("b"), F.col("cnt").alias("c_b"))
    total = bi.agg(F.sum("cnt").alias("n")).scalar()
    return bi.join(a, "a", "left").join(b, "b", "left").select(
        "a", "b", "cnt", F.greatest(F.coalesce("c_a", F.lit(1)), F.lit(1)).alias("c_a"),
        F.greatest(F.coalesce("c_b", F.lit(1)), F.lit(1)).alias("c_b"), total.alias("n"))


def association(metric: str) -> Column:
    """One of the three association measures over the columns of ``with_margins``."""
    cnt, c_a, c_b, n = (F.col(c).cast("double") for c in ("cnt", "c_a", "c_b", "n"))
    if metric == "dpmi":
        score = F.log(cnt - DPMI_DISCOUNT) - F.log(c_a) - F.log(c_b) + F.log(n)
        return F.when(cnt > DPMI_DISCOUNT, F.greatest(score, F.lit(0.0))).otherwise(0.0)
    if metric == "dice":
        return 2.0 * cnt / (c_a + c_b)
    if metric == "t_score":
        return F.when((cnt > 0) & (n > 0), F.try_divide(cnt - F.try_divide(c_a * c_b, n), F.sqrt(cnt))).otherwise(0.0)
    raise ValueError(f"unknown association measure {metric!r}, choose from {METRICS}")


def adjacency_entropy(bi: DataFrame) -> DataFrame:
    """(ch, h_left, h_right): natural-log entropy over predecessors and successors, NULL without any.

    With T the total, -sum(p ln p) = ln T - sum(c ln c)/T: two sums that combine on the map side.
    """
    def side(key: str, name: str) -> DataFrame:
        total = F.sum("cnt")
        weighted = F.sum(F.col("cnt") * F.log("cnt"))
        return bi.groupBy(F.col(key).alias("ch")).agg(
            F.greatest(F.log(total) - weighted / total, F.lit(0.0)).alias(name))

    return side("b", "h_left").join(side("a", "h_right"), "ch", "full")


@dataclass(frozen=True)
class NgramStats:
    """Counts, and the derived tables as views over them."""

    uni: DataFrame
    bi: DataFrame
    metric: str = "dpmi"

    @staticmethod
    def count(runs: DataFrame, metric: str = "dpmi", run: str = "run") -> "NgramStats":
        return NgramStats(as_table(unigrams(runs, run), "unigram"), as_table(bigrams(runs, run), "bigram"), metric)

    def save(self, path: str, batch: str | None = None) -> None:
        """Persist the counts only, as the newest version; everything else is recomputed."""
        spark = self.uni.sparkSession

        def write(folder: str) -> None:
            self.uni.write.parquet(f"{folder}/unigram")
            self.bi.write.parquet(f"{folder}/bigram")
            spark.range(1).select(F.lit(self.metric).alias("metric")).write.json(f"{folder}/meta")

        commit(spark, path, write, batch)

    def merged(self, other: "NgramStats") -> "NgramStats":
        """The statistics of both texts together: counts add up, the rest follows from them."""
        if self.metric != other.metric:
            raise ValueError(f"cannot merge statistics of {self.metric!r} and {other.metric!r}")
        uni = self.uni.unionByName(other.uni).groupBy("ch").agg(F.sum("cnt").alias("cnt"))
        bi = self.bi.unionByName(other.bi).groupBy("a", "b").agg(F.sum("cnt").alias("cnt"))
        return NgramStats(uni, bi, self.metric)

    def add_to(self, path: str, batch: str) -> None:
        """Merge into the statistics saved in ``path``; a batch that is in them already changes nothing."""
        spark = self.uni.sparkSession
        if has_batch(spark, path, batch):
            return
        saved = newest(spark, path)[1]
        (NgramStats.load(spark, path).merged(self) if saved else self).save(path, batch)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "NgramStats":
        path = folder_of(spark, path)
        metric = spark.read.schema("metric string").json(f"{path}/meta").first()["metric"]
        return NgramStats(spark.read.parquet(f"{path}/unigram"), spark.read.parquet(f"{path}/bigram"), metric)

    @property
    def pairs(self) -> DataFrame:
        """(a, b, cnt, logfreq, assoc)."""
        return with_margins(self.bi, self.uni).select(
            "a", "b", "cnt", log_freq(F.col("cnt")).alias("logfreq"), association(self.metric).alias("assoc"))

    @property
    def entropy(self) -> DataFrame:
        return adjacency_entropy(self.bi)


def stats_summary(stats: NgramStats) -> DataFrame:
    """One row of type and token counts and ranges."""
    def spread(col: str, name: str) -> list[Column]:
        return [F.min(col).alias(f"{name}_min"), F.max(col).alias(f"{name}_max"), F.avg(col).alias(f"{name}_mean")]

    uni = stats.uni.agg(F.lit(1).alias("k"), F.count(F.lit(1)).alias("uni_types"), F.sum("cnt").alias("uni_tokens"))
    zero = F.avg(F.when(F.col("assoc") > 0, 0.0).otherwise(1.0))
    bi = stats.pairs.agg(F.lit(1).alias("k"), F.count(F.lit(1)).alias("bi_types"), F.sum("cnt").alias("bi_tokens"),
                         *spread("logfreq", "logfreq"), *spread("assoc", "assoc"), zero.alias("assoc_zero"))
    ent = stats.entropy.agg(F.lit(1).alias("k"), *spread("h_left", "h_left"), *spread("h_right", "h_right"))
    return uni.join(bi, "k").join(ent, "k").drop("k")


__all__ = ["NgramStats", "adjacency", "adjacency_entropy", "association", "bigrams", "log_freq", "stats_summary",
           "unigrams", "with_margins"]
