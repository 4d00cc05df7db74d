"""Near-duplicate vectors against all pairs in double precision."""

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import queries, subspace

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def slow_similar(rows, threshold=0.93):
    """(vec_id, n_links, component_id) per row by comparing everything with everything."""
    x = []
    for _, v, label in rows:
        good = label is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        v = np.array(v, np.float64) if good else None
        x.append(v / np.abs(v).max() if good else None)
    near = [[j for j in range(len(rows)) if j != i and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j])
             and x[i] @ x[j] / (np.sqrt(x[i] @ x[i]) * np.sqrt(x[j] @ x[j])) >= threshold] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids, default=None) if x[i] is not None else rows[i][0]
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def planted(rng, n, dim, labels, spread):
    """Random vectors, chains and clusters around some of them, copies, multiples, pairs about the threshold."""
    rows = []
    for _ in range(n):
        v = rng.standard_normal(dim)
        label = int(rng.integers(labels))
        kind = rng.integers(6)
        rows.append((v, label))
        if kind == 0:
            rows += [(v + rng.standard_normal(dim) * spread * rng.random(), label) for _ in range(rng.integers(1, 12))]
        elif kind == 1:
            rows += [(v, label), (v * 3.5, label), (v, (label + 1) % labels)]
        elif kind == 2:
            for _ in range(6):
                v = v + rng.standard_normal(dim) * spread / 1.5
                rows.append((v, label))
        elif kind == 3:
            for cos in (0.9295, 0.93, 0.9305):
                w = rng.standard_normal(dim)
                w -= (w @ v) / (v @ v) * v
                rows.append((cos * v / np.linalg.norm(v) + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w), label))
    return rows


def test_similar_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    for dim, labels, limit in ((64, 3, 1 << 14), (64, 2, 40), (19, 1, 25), (3, 1, 60), (300, 1, 50)):
        made = planted(rng, 70, dim, labels, 0.33)
        rows = [(7 * i % len(made) * 3, np.asarray(v, np.float32).tolist(), label) for i, (v, label) in enumerate(made)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert result(subspace.similar_vectors(df, limit=limit)) == slow_similar(rows), (dim, limit)


def test_similar_vectors_on_odd_rows(spark):
    one, other = [1.0] + [0.0] * 15, [0.0] * 15 + [1.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 16, 1), (4, [1.0, None] * 8, 1), (5, [nan] * 16, 1), (6, [inf] + [1.0] * 15, 1), (7, one, None), (8, one, None), (9, one, 1),
            (9, one, 1), (None, one, 1), (2**60 + 1, one, 1), (10, other, 1), (None, other, 2), (None, other, 2), (11, [1.0], 1), (12, [2.0], 1), (13, [-2.0], 1),
            (14, [1e300] * 16, 3), (15, [1e-300] * 16, 3), (16, [1e300, -1e300] * 8, 3)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double")).withColumn("key", F.lit("clash")).withColumn("rep", F.lit("clash"))
    assert result(subspace.similar_vectors(df)) == slow_similar(rows)
    assert result(subspace.similar_vectors(df, limit=1)) == slow_similar(rows)
    assert subspace.similar_vectors(df.limit(0)).count() == 0


def test_a_dense_group_hands_on_a_forest(spark):
    rng = np.random.default_rng(4)
    middle = rng.standard_normal(64)
    middle /= np.linalg.norm(middle)
    x = middle + rng.standard_normal((600, 64)) * 0.012
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    for limit in (1 << 14, 100):
        got = result(subspace.similar_vectors(df, limit=limit))
        assert all(r[1:] == (599, 0, r[0] == 0) for r in got)
    reps = spark.createDataFrame([(i, 1, i, "0", 64, c.tobytes(), float(b), float(e), b"") for i, (c, b, e) in enumerate(zip(*map(list, subspace.coded(x))))],
                                 "rep bigint, n bigint, first bigint, label string, dim int, code binary, block_error double, error double, vector binary")
    found = subspace.candidate_links(reps.select("rep", "n", "first", "label", "dim", "code", "block_error", "error", "vector"), 0.93, 1 << 14)
    assert found.count() <= 8 * 2 * 600


def test_similar_query_on_the_table(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert result(queries.op12_similar(spark, data)) == slow_similar(rows)
