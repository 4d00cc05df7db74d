"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into m segments of about as many bits as the number of codes has, rather fewer than more, so
that a bucket holds a few codes at any size: verifying these is cheaper than probing more buckets. If two codes differ in at most m(r + 1) - 1 bits, some segment differs in at most r. So
after all buckets within radius r of a query's segments have been looked up and verified, everything up to that
distance is known: a query whose k-th verified distance is not larger is finished, the others go on with radius
r + 1. A bucket's codes are verified inside the join, and only those no farther than the k-th so far leave it. Once a radius has more buckets than there are codes, the
queries still open are compared with all codes, in blocks.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import as_table

BITS = 64
BLOCKS = 64


def segments(codes: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment for an index of so many codes."""
    m = max(2, min(8, ceil(BITS / log2(max(2, codes)))))
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def sign_code(vector: Column) -> Column:
    """Bit i of a BIGINT is set if component i of up to 64 is above zero; null, missing and NaN components count as not."""
    bits = F.transform(F.coalesce(vector, F.array().cast("array<float>")), lambda x, i: F.call_function(
        "shiftleft", F.when((x > 0) & ~F.isnan(x), F.lit(1)).otherwise(F.lit(0)).cast("bigint"), i))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def _segment(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1))


def _masks(radius: int, width: int) -> Column:
    """All differences of ``radius`` bits, as one foldable text literal: thousands of literals would swell the plan."""
    masks = (sum(1 << b for b in bits) for bits in combinations(range(width), radius))
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest (d, id) of each query code."""
    order = Window.partitionBy("q").orderBy("d", "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _first_ids(codes: DataFrame, k: int) -> DataFrame:
    """(code, ids): the k smallest ids of each distinct code; a code of very many rows is first cut down in 64 parts."""
    part = F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")
    few = codes.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("code", "part").orderBy("id"))).where(F.col("n") <= k)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    return few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def top_k(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for each row where ``queries`` holds its k nearest other rows.

    Distance is the Hamming distance of the sign codes, ties go to the smaller id; a query is not its own
    neighbour. With fewer than k other rows all of them are returned. Rows with a null id are left out, they
    could neither be a query nor be named; null vectors have code zero; an id that occurs several times
    counts once, with its smallest code; further columns are ignored; an empty table gives an empty result.
    """
    coded = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), sign_code(F.col(vector_col)).alias("code"), F.coalesce(queries, F.lit(False)).alias("asks"))
    coded = as_table(coded.groupBy("id").agg(F.min("code").alias("code"), F.max("asks").alias("asks")), "topk-codes")
    # one more than k, as the query itself is among them
    index = as_table(_first_ids(coded.select("id", "code"), k + 1), "topk-index")
    n_codes = index.count()
    asked = as_table(coded.where("asks").select("id", "code"), "topk-asked")
    cuts = segments(n_codes)
    open_ = as_table(asked.select(F.col("code").alias("q"), F.lit(BITS).alias("bound")).distinct(), "topk-open")
    found = as_table(open_.select("q", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("int").alias("d")).where("false"), "topk-found")
    settled, radius = [], 0
    while not open_.isEmpty():
        # the k-th distance so far bounds what is still of use; equal distances count for their ids
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        widest = cuts[0][1]
        if radius > widest or comb(widest, radius) * len(cuts) > max(n_codes, 1):
            # fewer codes than buckets: the open queries, copied per block of codes, against all codes
            blocks = open_.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
            of_block = index.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(BLOCKS)).cast("int"))
            hits = blocks.join(of_block.hint("merge"), "block").where(distance <= F.col("bound")).select("q", "ids", distance.alias("d"))
            settled.append(_best(hits.select("q", F.explode("ids").alias("id"), "d"), k + 1))
            break
        parts = lambda code: F.posexplode(F.array(*[_segment(F.col(code), *c) for c in cuts])).alias("s", "v")
        masks = F.lit(None).cast("array<bigint>")
        for width in {w for _, w in cuts}:
            of_width = F.col("s").isin([i for i, (_, w) in enumerate(cuts) if w == width])
            masks = F.when(of_width, _masks(radius, width)).otherwise(masks)
        probes = open_.select("q", "bound", parts("q"))
        probes = probes.select("q", "bound", "s", F.explode(F.transform(masks, lambda m: F.col("v").bitwiseXOR(m))).alias("v"))
        buckets = index.select("code", "ids", parts("code"))
        # probes are many more than the planner sees before the explode: never broadcast them
        hits = probes.join(buckets.hint("merge"), ["s", "v"])
        # a code is taken from its first segment at the smallest radius only, so none is verified twice
        apart = [F.bit_count(_segment(F.col("q").bitwiseXOR(F.col("code")), *c)) for c in cuts]
        first = F.array_position(F.array(*apart), F.least(*apart)) - 1
        hits = hits.where((distance <= F.col("bound")) & (first == F.col("s")) & (F.least(*apart) == radius)).select("q", "ids", distance.alias("d"))
        new = hits.select("q", F.explode("ids").alias("id"), F.col("d").cast("int").alias("d"))
        best = as_table(_best(found.unionByName(new), k + 1), "topk-found")
        last = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("kth"))
        sure = F.lit(len(cuts) * (radius + 1) - 1)
        done = as_table(last.where((F.col("n") >= k + 1) & (F.col("kth") <= sure)).select("q"), "topk-done")
        settled.append(best.join(done, "q", "left_semi"))
        known = last.where(F.col("n") >= k + 1).select("q", "kth")
        open_ = as_table(open_.join(done, "q", "left_anti").join(known, "q", "left").select(
            "q", F.coalesce("kth", F.lit(BITS)).cast("int").alias("bound")), "topk-open")
        found = best.join(open_.select("q"), "q", "left_semi")
        radius += 1
    result = settled[0] if settled else found
    for part in settled[1:]:
        result = result.unionByName(part)
    result = as_table(result.select("q", "id", F.col("d").cast("int").alias("d")), "topk-result")
    near = result.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("near"))  # k + 1 at most
    out = asked.join(near, asked.code == near.q).select(
        F.col("id").alias("query_id"), F.expr(f"slice(filter(near, x -> x.id <> id), 1, {int(k)})").alias("near"))
    return out.select("query_id", F.posexplode("near").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.col("x.d").alias("distance"))
