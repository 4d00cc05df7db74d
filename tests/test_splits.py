import hashlib

from pyspark.sql import functions as F

from spanloom.operators import splits as sp
from spanloom.plans.scale import exact_rank, fits_broadcast, hot_keys, keyed_join, lookup_join, rank_digits, split_by_filter, table_bytes


def sents(make_sent, n=211):
    # One category holds most sentences.
    return make_sent([["w"]] * n, category=["big" if i % 10 else "small" for i in range(n)])


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


def test_rank_is_the_global_order(spark, make_sent):
    s = sents(make_sent).select("sid", F.md5(F.concat_ws("|", F.lit("42"), F.col("sid").cast("string"))).alias("h"))
    for digits in (1, 3):
        got = {r["sid"]: (r["rank"], r["n"]) for r in exact_rank(s, "h", "sid", digits=digits).collect()}
        assert got == {i: (k, 211) for k, i in enumerate(order(range(211)))}


def test_stratified_split_sizes(make_sent):
    rows = sp.stratified_split(sents(make_sent)).groupBy("category", "split").count().collect()
    got = {(r["category"], r["split"]): r["count"] for r in rows}
    assert got == {("big", "train"): 151, ("big", "dev"): 18, ("big", "test"): 20,
                   ("small", "train"): 17, ("small", "dev"): 2, ("small", "test"): 3}


def test_small_category_goes_to_train(make_sent):
    assert {r["split"] for r in sp.stratified_split(make_sent([["a"], ["b"]])).collect()} == {"train"}


def test_random_split_sizes(make_sent):
    rows = sp.random_split(sents(make_sent)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"train": 168, "dev": 21, "test": 22}


def test_folds_partition_the_data(make_sent):
    s = sents(make_sent)
    folds = sp.stratified_kfold(s)
    assert folds.count() == 211 and folds.select("sid").distinct().count() == 211
    per = folds.groupBy("category").agg(F.countDistinct("fold").alias("k"))
    assert all(r["k"] == 5 for r in per.collect())
    roles = sp.fold_roles(folds).groupBy("run", "role").count().collect()
    for run in range(5):
        n = {r["role"]: r["count"] for r in roles if r["run"] == run}
        assert sum(n.values()) == 211 and n["dev"] == int((211 - n["test"]) * 0.111)
    # Half-even bounds of 5 sentences over 2 folds: 0, 2, 5.
    two = sp.kfold(make_sent([["a"]] * 5), k=2).groupBy("fold").count().collect()
    assert {r["fold"]: r["count"] for r in two} == {0: 2, 1: 3}


def test_group_split(spark):
    df = spark.createDataFrame([(i % 12, i) for i in range(60)], "g bigint, x int")
    got = {r["g"]: r["split"] for r in sp.group_split(df, "g").collect()}
    assert {g for g, v in got.items() if v == "valid"} == set(order(range(12))[:5])


def test_salted_join_keeps_every_row(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    for how, n in (("inner", 667), ("left", 1000)):
        for fits in (True, False):
            out = keyed_join(big, small, ["k"], how, small_fits=fits, spread=["id"])
            assert out.count() == n and out.select("id").distinct().count() == n
    assert table_bytes(small) > 0


def test_lookup_join_splits_hot_keys_and_drops_strangers(spark):
    """A third of the rows on one key, null keys, keys without a partner; the same rows as a broadcast join."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 900)
    big = spark.range(6000).select("id", key.cast("bigint").alias("k"), F.lit("x").alias("b"))
    small = spark.range(-1, 300).select(F.col("id").alias("k"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("v"))
    for how in ("inner", "left"):
        want = sorted(map(repr, lookup_join(big, small, ["k"], how, small_fits=True).select("id", "k", "b", "v").collect()))
        out = lookup_join(big, small, ["k"], how, small_fits=False, share=10)
        assert sorted(map(repr, out.select("id", "k", "b", "v").collect())) == want
        plan = out._jdf.queryExecution().analyzed().toString()
        assert "_salt" not in plan and "Generate" not in plan
    cut = split_by_filter(big, small, ["k"])
    assert cut.where("_maybe and k is null").count() == 0 and cut.where("not _maybe and k < 300").count() == 0
    assert cut.where("not _maybe and k >= 300").count() > 0.8 * cut.where("k >= 300").count()
    assert [r["k"] for r in hot_keys(big.where("k is not null"), ["k"], 10).collect()] == [-1]
    assert lookup_join(big, small.limit(0), ["k"], "left", small_fits=False).count() == 6000
    assert lookup_join(big.limit(0), small, ["k"], "inner", small_fits=False).count() == 0


def test_rank_digits_follow_the_rows():
    assert [rank_digits(n) for n in (0, 1 << 32, (1 << 32) + 1, 10**12)] == [3, 3, 4, 5]


def test_size_counts_what_arrays_and_structs_hold(spark):
    text = "x" * 1000
    df = spark.range(100).select(F.struct(F.lit(text).alias("a"), F.array(F.lit(text), F.lit(text)).alias("b")).alias("s"))
    assert 300_000 < table_bytes(df) < 330_000
    assert fits_broadcast(df, 700_000) and not fits_broadcast(df, 400_000)
