"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.catalog.relations import compose
from spanloom.sources.corpus import Corpus, open_corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(corpus) -> DataFrame`` under ``name``; ``sql`` may use the relations of ``relations``."""

    def add(fn: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, path: fn(open_corpus(spark, path))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return add


def r6(col: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def joined(col: Column | str, sep: str = " ") -> Column:
    return F.array_join(col, sep)


def weighted(features: DataFrame, names, keys=("sid",)) -> DataFrame:
    """Per sentence, each feature summed with weight position + 1: sensitive to value and place."""
    if "pos" not in features.columns:  # summed by the operator, in the sentence's row
        return features.select(*keys, *[r6(F.col(f"`{n}`")).alias(n.lower()) for n in names])
    place = F.col("pos") + 1
    return features.groupBy(*keys).agg(*[r6(F.sum(F.col(f"`{n}`") * place)).alias(n.lower()) for n in names])


def weighted_sql(names, source: str) -> str:
    sums = ", ".join(f'round(sum("{n}" * (pos + 1))::DOUBLE, 6) + 0.0 AS "{n.lower()}"' for n in names)
    return f"SELECT sid, {sums} FROM {source} GROUP BY sid"
