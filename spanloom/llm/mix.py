"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is the number of rows it should contribute divided by the rows it has. Every document draws
its number of copies from a Poisson distribution with that mean, by inverting the distribution function at a
number hashed from seed and id; it is exploded into its copies, and a hash of (seed, id, copy) deals the
copies out and orders them within the parts, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.plans.scale import fits_broadcast, keyed_join

#: Larger rates are split into equal parts of at most this mean, whose draws add up.
PART = 16.0
#: Terms of the distribution function; beyond them it is 1 within double precision for a mean of 16.
TERMS = 97
ALPHA, SEED = 0.7, 17


def unit(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, hashed from the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(counts: DataFrame, weights: dict[str | None, float] | None, total: int | None, alpha: float) -> DataFrame:
    """(key, rate, parts, cdf) per source from (key, source, n): target share times ``total`` over its rows.

    Without ``weights`` the shares follow n ** alpha: small sources are raised, large ones lowered. Sources
    that ``weights`` does not name get none.
    """
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sized = counts.withColumn("w", weight)
    sums = sized.agg(F.sum("w").alias("w_all"), F.sum("n").alias("n_all")).first()  # two numbers
    rows = float(total if total is not None else sums["n_all"] or 0)
    rate = F.when(F.col("n") > 0, F.lit(rows) * F.col("w") / F.lit(float(sums["w_all"] or 1.0)) / F.col("n"))
    with_rate = sized.withColumn("rate", rate).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def grow(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return with_rate.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, grow)["cdf"]).select(
        "_key", "rate", "parts", "cdf")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, alpha: float = ALPHA,
        seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` plus n_copies, copy (1 to n_copies) and shuffle_key, globally shuffled.

    ``total`` is the expected number of rows (default: as many as there are). A null source is a source of
    its own. The draw depends on seed and id alone, so repeated rows are replicated alike and null ids share
    one draw. A source of weight 0 gives no rows; an empty table gives an empty one. Columns of ``docs``
    named like the added ones are replaced.
    """
    added = ["n_copies", "copy", "shuffle_key"]
    key = F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], key.alias("_key"))
    counts = rows.groupBy("_key").agg(F.first(source_col, ignorenulls=True).alias("source"), F.count(F.lit(1)).alias("n"))
    table = rates(counts, weights, total, alpha)
    drawn = keyed_join(rows, table, ["_key"], "inner", small_fits=fits_broadcast(table), spread=[id_col])

    def draw(part):
        u = unit(F.lit(seed), F.col(id_col), part)
        return F.size(F.filter("cdf", lambda c: c <= u))

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), draw), F.lit(0), lambda a, n: a + n)
    copies = drawn.withColumn("n_copies", count).where("n_copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    shuffle_key = F.md5(F.concat_ws("|", F.lit("order"), F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                                    F.col("copy").cast("string")))
    out = copies.withColumn("shuffle_key", shuffle_key).drop("_key", "rate", "parts", "cdf")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_sql(source: str = "documents", alpha: float = ALPHA, seed: int = SEED) -> str:
    """DuckDB SQL for the rows of ``mix`` with its default weights, columns doc_id, source, text, n_copies, copy, shuffle_key."""
    return f"""
WITH c AS (SELECT source, count(*) AS n FROM {source} GROUP BY source),
r0 AS (SELECT source, (SELECT sum(n) FROM c) * pow(n, {alpha}) / (SELECT sum(pow(n, {alpha})) FROM c) / n AS rate FROM c),
r AS (SELECT source, greatest(1, ceil(rate / {PART}))::INT AS parts, rate FROM r0),
p AS (SELECT source, parts, k, exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) AS p FROM r, range(0, {TERMS}) t(k)),
cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM p),
u AS (SELECT d.doc_id, d.source, j, ('0x' || substr(md5('{seed}|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || j), 1, 13))::BIGINT / {float(1 << 52)} AS u
  FROM (SELECT DISTINCT doc_id, source FROM {source}) d JOIN r ON d.source IS NOT DISTINCT FROM r.source, generate_series(1, r.parts) g(j)),
n AS (SELECT u.doc_id, u.source, count(*)::INT AS n_copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.f <= u.u GROUP BY u.doc_id, u.source)
SELECT d.doc_id, d.source, d.text, n.n_copies, i::INT AS copy, md5('order|{seed}|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || i) AS shuffle_key
FROM {source} d JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.source IS NOT DISTINCT FROM n.source, generate_series(1, n.n_copies) s(i)"""
