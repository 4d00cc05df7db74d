"""Mixing, exact deduplication and top-k search: against SQL and brute force, and on odd inputs."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import dedup, mix, topk

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(1, "a  b", "en", "s", 4), (2, "a\tb", "en", "s", 3), (2, "a\tb", "en", "s", 3), (None, "a b", "en", None, 3), (3, None, None, None, None),
       (4, "", "en", "s", 0), (5, " ", "en", "t", 1), (6, "x " * 200_000, "en", "t", 1), (None, "only", "en", "t", 4)]


def test_exact_groups_on_odd_rows(spark):
    rows = spark.createDataFrame(ODD, DOCS).withColumn("sha", F.lit("clash")).withColumn("maybe", F.lit(1)).withColumn("rid", F.lit(1))
    got = dedup.exact_groups(rows).collect()
    assert len(got) == len(ODD)
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    same = [r for r in got if r["text_sha256"] == norm("a b")]
    assert len(same) == 4 and {(r["keep_id"], r["group_size"]) for r in same} == {(1, 4)}
    assert [r["doc_id"] for r in same if r["kept"]] == [1]
    empty = [r for r in got if r["text_sha256"] == norm("")]
    assert {r["doc_id"] for r in empty} == {3, 4} and {r["keep_id"] for r in empty} == {3}
    assert sum(r["kept"] for r in got) == len({norm(t) for _, t, *_ in ODD})
    assert dedup.exact_groups(rows.limit(0)).count() == 0
    assert dedup.drop_exact(spark.createDataFrame(ODD, DOCS)).columns == DOCS.replace(" bigint", "").replace(" string", "").split(", ")


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_a_full_filter_loses_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(dedup, "filter_bits", lambda n: bits)
    rng = random.Random(1)
    rows = [(i, f"t{rng.randrange(300)}", "", "", 0) for i in range(600)]
    got = {r["doc_id"]: r for r in dedup.exact_groups(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t, *_ in rows:
        ids = [j for j, u, *_ in rows if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(ids), len(ids), i == min(ids))


def test_only_possible_repeats_are_shuffled(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    flagged = dedup.possibly_repeated(rows.unionAll(rows.where("doc_id < 5")), dedup.filter_bits(5000), 2).where("maybe")
    assert 10 <= flagged.count() < 100


def _poisson(rate, u):
    k, p = 0, math.exp(-rate)
    f = p
    while f <= u:
        k += 1
        p *= rate / k
        f += p
    return k


def test_mix_inverts_the_poisson_distribution(spark):
    rows = [(i, "x", "en", "big" if i % 10 else "small", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit("clash"))
    got = mix.mix(docs, {"big": 1.0, "small": 3.0}, total=80_000).groupBy("doc_id", "n_copies").count().collect()
    assert all(r["count"] == r["n_copies"] for r in got)
    n = {r["doc_id"]: r["n_copies"] for r in got}
    rate = {"big": 20_000 / 3600, "small": 60_000 / 400}
    for i, _, _, source, _ in rows[:300]:
        parts = max(1, math.ceil(rate[source] / mix.PART))
        us = [int(hashlib.md5(f"{mix.SEED}|{i}|{j}".encode()).hexdigest()[:13], 16) / 2**52 for j in range(1, parts + 1)]
        assert n.get(i, 0) == sum(_poisson(rate[source] / parts, u) for u in us)
    small = sum(v for k, v in n.items() if k % 10 == 0)
    assert abs(small - 60_000) < 1500 and abs(sum(n.values()) - 80_000) < 2000


def test_mix_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    out = mix.mix(docs, total=900)
    assert out.columns == [*docs.columns, "n_copies", "copy", "shuffle_key"]
    assert {r["source"] for r in out.collect()} == {"s", "t", None}
    assert mix.mix(docs.limit(0)).count() == 0
    assert {r["source"] for r in mix.mix(docs, {None: 1.0}, total=50).collect()} == {None}
    assert out.drop("text").exceptAll(mix.mix(docs.repartition(3), total=900).drop("text")).count() == 0


def _brute(vectors, k):
    code = {i: sum(1 << b for b, x in enumerate(v or []) if x is not None and x > 0) for i, v in vectors}
    return {(q, n + 1, i, d) for q in code if q % 50 == 0 for n, (d, i) in enumerate(sorted(
        (bin(code[q] ^ c).count("1"), i) for i, c in code.items() if i != q)[:k])}


@pytest.mark.parametrize("n, spread", [(3, 1.0), (2000, 0.35), (900, 0.0)])
def test_topk_equals_brute_force(spark, n, spread):
    rng = random.Random(n)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    vectors = [(i, [x + spread * rng.gauss(0, 1) for x in base[i % 5]]) for i in range(n)]
    if n > 100:
        vectors[50] = (50, None)
        vectors[60] = (60, [None] * 64)
        vectors[70] = (70, [float("nan")] * 64)
    rows = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("d", F.lit("clash"))
    rows = rows.unionByName(rows.limit(1)).unionByName(spark.createDataFrame([(None, None, "x")], rows.schema))
    got = topk.top_k(rows, F.col("vec_id") % 50 == 0, 10)
    want = _brute([(i, None if v is None else [None if x is None or x != x else x for x in v]) for i, v in vectors], 10)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(rows.limit(0), F.col("vec_id") % 50 == 0, 10).count() == 0
