"""Helpers of this subpackage: written intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.scale import fits_broadcast
from spanloom.session import as_table

#: Runs of ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
#: Rounds after which components() gives up with an error; a graph shrinks geometrically, so this is never near.
MAX_ROUNDS = 64


def exact_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Ids travel through Python as text, as pandas would turn integers beside nulls into floats; back to BIGINT."""
    return df.withColumn(name, F.col(name).cast("bigint"))


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` written once with a number that is unique per row, and the name of that column."""
    column = "_row"
    while column in map(str.lower, docs.columns):
        column = f"_{column}"
    return as_table(docs.withColumn(column, F.monotonically_increasing_id()), name), column


def by_number(rows: DataFrame, numbers: DataFrame, column: str, how: str, name: str) -> DataFrame:
    """Semi- or anti-join of ``rows`` with row numbers; these are written, and broadcast if they fit, so that texts stay where they are."""
    numbers = as_table(numbers.select(column), name)
    return rows.join(F.broadcast(numbers) if fits_broadcast(numbers) else numbers, column, how)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); nodes that are connected get one label, a node of theirs.

    Each round every node points to its smallest neighbour, pointers are followed one step further, and the
    edges are rewritten to the nodes pointed at. Edges inside a merged group vanish, so the graph shrinks
    quickly; the rounds' pointers are composed at the end. All steps are aggregates with map-side
    combination or equi-joins that AQE may split; nothing is collected. Null ends and loops are ignored;
    an empty table gives an empty result.
    """
    edges = as_table(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    pointers = []
    for _ in range(MAX_ROUNDS):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("to"))
        first = as_table(first, f"{name}-first")
        beyond = first.select(F.col("node").alias("to"), F.col("to").alias("label"))
        jump = as_table(first.join(beyond, "to").select("node", "label"), f"{name}-jump")
        pointers.append(jump)
        at = lambda end: jump.select(F.col("node").alias(end), F.col("label").alias(f"n{end}"))
        edges = as_table(
            edges.join(at("a"), "a").join(at("b"), "b").where("na <> nb")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), f"{name}-edges")
        if edges.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    labels = pointers[0]
    for step in pointers[1:]:
        step = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return labels
