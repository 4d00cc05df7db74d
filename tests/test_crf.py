"""Sequence training: sums and gradient against enumeration, the optimiser's conditions, the taggers."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.api import JointSegmenter, JointSegmenterModel, TaggerSegmenter, TaggerSegmenterModel, chosen_features
from spanloom.functions.script import length_bin
from spanloom.operators import crf
from spanloom.operators import features as fe
from spanloom.operators.lattice import Lexicon
from spanloom.operators.ngrams import NgramStats

NAMED, NUMERIC, LEVELS, LABELS, COLUMNS = 6, 2, 3, 3, 2


def problem(seed, sentences=5):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 5, sentences)
    n = int(sizes.sum())
    return (rng.integers(-1, NAMED, (n, COLUMNS)), rng.standard_normal((n, NUMERIC)), rng.integers(0, LABELS, n), sizes,
            rng.standard_normal((NAMED + NUMERIC + LABELS, LEVELS, LABELS)))


def slow_loss(theta, ids, dense, y, sizes, level):
    """Negative log-likelihood of one level by enumerating all label sequences."""
    w, loss, at = theta[:, level], 0.0, 0
    for n in sizes:
        e = [sum((w[f] for f in ids[i] if f >= 0), np.zeros(LABELS)) + dense[i] @ w[NAMED:NAMED + NUMERIC] for i in range(at, at + n)]

        def score(path):
            return sum(e[i][p] for i, p in enumerate(path)) + sum(w[NAMED + NUMERIC + p, q] for p, q in zip(path, path[1:]))

        every = [score(p) for p in itertools.product(range(LABELS), repeat=n)]
        loss += np.logaddexp.reduce(every) - score(y[at:at + n])
        at += n
    return loss


def test_loss_equals_enumeration_and_gradient_equals_differences(monkeypatch):
    for seed in range(8):
        ids, dense, y, sizes, theta = problem(seed)
        monkeypatch.setattr(crf, "CELLS", 1 << 22 if seed % 2 else 40)
        loss, gradient = crf.loss_and_gradient(theta, ids, dense, y, sizes)
        for level in range(LEVELS):
            assert loss[level] == pytest.approx(slow_loss(theta, ids, dense, y, sizes, level))
        for at in np.ndindex(theta.shape):
            step = np.zeros(theta.shape)
            step[at] = 1e-6
            up, down = (crf.loss_and_gradient(theta + s, ids, dense, y, sizes)[0][at[1]] for s in (step, -step))
            assert gradient[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_large_scores_stay_finite():
    ids, dense, y, sizes, theta = problem(3)
    loss, gradient = crf.loss_and_gradient(theta * 150, ids, dense, y, sizes)
    assert np.isfinite(loss).all() and np.isfinite(gradient).all()
    assert loss[1] == pytest.approx(slow_loss(theta * 150, ids, dense, y, sizes, 1))


def test_best_labels_equal_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([5, 4, 4, 2, 1, 1])
    n = int(sizes.sum())
    scores, trans = rng.integers(0, 4, (n, LEVELS, LABELS)).astype(float), rng.integers(0, 3, (LEVELS, LABELS, LABELS)).astype(float)
    start, end = rng.integers(0, 3, LABELS).astype(float), rng.integers(0, 3, LABELS).astype(float)
    got = crf.best_labels(scores, trans, sizes, start, end)
    for level in range(LEVELS):
        for at, size in zip(np.cumsum(sizes) - sizes, sizes):
            def total(p):
                return start[p[0]] + end[p[-1]] + sum(scores[at + i, level, x] for i, x in enumerate(p)) + sum(trans[level, a, b] for a, b in zip(p, p[1:]))
            assert total(got[at:at + size, level]) == max(total(p) for p in itertools.product(range(LABELS), repeat=int(size)))


def test_long_sentence_decodes_in_linear_memory():
    rng = np.random.default_rng(3)
    n = 100_000
    scores, trans = rng.random((n, 1, 4)), rng.random((1, 4, 4))
    got = crf.best_labels(scores, trans, np.array([n]), np.zeros(4), np.zeros(4))[:, 0]
    head = crf.best_labels(scores[:2000], trans, np.array([2000]), np.zeros(4), np.zeros(4))[:, 0]
    assert (got[:1900] == head[:1900]).all() and len(got) == n


def test_minimum_meets_the_conditions_of_both_penalties():
    """At the minimum the pseudo-gradient vanishes; models in one array reach what each reaches alone."""
    problems = [problem(seed, 40) for seed in (1, 2)]
    mask = np.ones((2, NAMED + NUMERIC + LABELS, LEVELS, LABELS), bool)
    mask[:, 3, 1] = mask[:, NAMED + 1, 2] = False

    def evaluate(theta, wanted):
        out = [crf.loss_and_gradient(t, *p[:4]) for t, p in zip(theta, problems)]
        return np.stack([x for x, _ in out]), np.stack([g for _, g in out])

    def total(theta, c1, c2):
        return evaluate(theta, None)[0] + c1 * np.abs(theta).sum((1, 3)) + c2 * np.square(theta).sum((1, 3))

    for c1, c2 in ((1.0, 1e-3), (0.0, 0.1), (3.0, 0.0)):
        theta = crf.minimise(evaluate, mask, c1, c2, 300)
        assert (theta[~mask] == 0).all()
        slope = crf.pseudo_gradient(theta, evaluate(theta, None)[1] + 2 * c2 * theta, c1) * mask
        assert np.abs(slope).max() < 0.05
        best = total(theta, c1, c2)
        rng = np.random.default_rng(0)
        for _ in range(20):
            assert (total(theta + rng.standard_normal(theta.shape) * 0.02 * mask, c1, c2) >= best - 1e-6).all()
        if c1 == 3.0:
            assert (theta == 0).sum() > (~mask).sum()  # the penalty leaves zeros


def corpus(n, seed=1):
    """Words told apart by what follows, and a middle character that only the sequence tells."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words, tags = [], []
        for _ in range(3):
            verb = rng.random() < 0.5
            words += ["ab", "c" if verb else "d"]
            tags += ["v" if verb else "n", "u"]
        rows.append((i, "k", words, tags, "".join(words)))
    return rows


SCHEMA = "sid bigint, category string, words array<string>, tags array<string>, s string"


def test_feature_index_has_no_gaps_and_no_collisions(spark):
    sent = spark.createDataFrame(corpus(30), SCHEMA)
    rows = crf.named_features(crf.window_features(sent, crf.single_words(sent)))
    index = {r["feature"]: r["id"] for r in crf.feature_index(rows).collect()}
    assert set(index) == {r["feature"] for r in rows.where("feature is not null").distinct().collect()}
    assert sorted(index.values()) == list(range(len(index)))
    often = {r["feature"] for r in crf.feature_index(rows, 40).collect()}
    assert often == {r["feature"] for r in rows.where("feature is not null").groupBy("feature").count().where("count >= 40").collect()}


def test_spark_evaluation_equals_one_process(spark):
    sent = spark.createDataFrame(corpus(40), SCHEMA)
    runs = sent.withColumn("run", F.explode(F.when(F.col("sid") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn(
        "sid", F.col("sid") * 2 + F.col("run"))
    extra = runs.select("sid", F.posexplode(F.split("s", "")).alias("pos", "ch")).select("sid", "pos", (F.col("pos") % 2).cast("double").alias("odd"))
    y = F.transform(F.split("s", ""), lambda ch: F.when(ch == "a", 0).when(ch == "b", 2).otherwise(3))
    rows, index = crf.training_table(runs, crf.single_words(sent), y, extra, ("odd",), runs=2)
    features = index.count()
    theta = np.random.default_rng(1).standard_normal((2, features + 1 + 4, 2, 4))
    losses, gradients = crf.evaluator(rows, 2, 1)(theta, np.ones((2, 2), bool))
    for run in (0, 1):
        part = rows.where(F.col("run") == run).toPandas()
        assert len(part) == (40 if run == 0 else 14)
        loss, gradient = crf.loss_and_gradient(theta[run], *crf._arrays(part, 1))
        assert np.allclose(loss, losses[run]) and np.allclose(gradient, gradients[run])
    part, _ = crf.evaluator(rows, 2, 1)(theta, np.array([[False, False], [False, True]]))
    assert part[1, 1] == pytest.approx(losses[1, 1]) and (part.ravel()[:3] == 0).all()


def test_joint_field_tags_by_the_neighbour(spark, tmp_path):
    train = spark.createDataFrame(corpus(200), SCHEMA)
    model = JointSegmenter(dict_level=0, gap_level=0).fit(train)
    model.save(str(tmp_path / "j"))
    raw = spark.createDataFrame([(1, "abcabd", "k"), (2, "", "k"), (3, None, "k")], "sid bigint, s string, kept string")
    for m in (model, JointSegmenterModel.load(spark, str(tmp_path / "j"))):
        out = {r["sid"]: (r["pred_words"], r["pred_tags"]) for r in m.transform(raw).collect()}
        assert out[1] == (["ab", "c", "ab", "d"], ["v", "u", "n", "u"])
        assert out[2] == out[3] == ([], [])
    assert model.tagger.weights.where("forall(w, x -> x = 0)").count() == 0


def test_char_field_with_dictionary_and_gaps(spark, tmp_path):
    rng, rows = random.Random(4), []
    words = ["ab", "ba", "aab", "b", "a", "bbb"]
    for i in range(150):
        w = [rng.choice(words) for _ in range(6)]
        rows.append((i, "k", w, ["n"] * 6, "".join(w)))
    train = spark.createDataFrame(rows, SCHEMA)
    lex = Lexicon.build(spark.createDataFrame([(w, False, False, False) for w in words if len(w) > 1],
                                              "word string, has_yi boolean, has_yin boolean, has_book_title boolean")
                        .selectExpr("word", "length(word) AS len", "CASE WHEN length(word) = 2 THEN '2' ELSE '3' END AS bin", "has_yi", "has_yin", "has_book_title"))
    stats = NgramStats.count(train.selectExpr("cast(sid as string) AS rid", "s AS run"))
    model = TaggerSegmenter(lex, stats, max_rows=100, max_iter=30).fit(train)
    model.save(str(tmp_path / "t"))
    raw = train.select("sid", "s").limit(20)
    a = sorted(map(str, model.transform(raw).collect()))
    assert a == sorted(map(str, TaggerSegmenterModel.load(spark, str(tmp_path / "t")).transform(raw).collect()))
    for r in model.labels(raw).join(raw, "sid").collect():
        assert "".join(r["pred_words"]) == r["s"] and len(r["labels"]) == len(r["s"])


def test_rows_are_bounded(spark):
    sent = spark.createDataFrame(corpus(50), SCHEMA)
    assert crf.bounded_rows(sent, 20).count() == 20 and crf.bounded_rows(sent, None).count() == 50
    assert {r["sid"] for r in crf.bounded_rows(sent, 20).collect()} <= {r["sid"] for r in crf.bounded_rows(sent, 30).collect()}


def test_labels_made_in_the_row_equal_those_by_joins(spark, make_sent):
    rng = random.Random(5)
    sents = [["".join(rng.choice("abc1-\U00018800") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))] for _ in range(40)]
    sent = make_sent(sents)
    words = spark.createDataFrame([(w, True, False, None) for w in sorted({w for s in sents for w in s if len(w) > 1})],
                                  "word string, has_yi boolean, has_yin boolean, has_book_title boolean")
    lex = Lexicon.build(words.withColumn("bin", length_bin(F.length("word"))))
    stats = NgramStats.count(spark.createDataFrame([("".join(s),) for s in sents], "run string"))
    for kind in (TaggerSegmenter, JointSegmenter):
        model = kind(lex, stats, max_rows=30, max_iter=3).fit(sent)
        rows = sent.select("sid", "s").union(spark.createDataFrame([(1000, ""), (1001, None), (None, "ab")], "sid bigint, s string"))
        numbers = fe.feature_numbers(model.tagger.numeric, lex, model.counts, stats)
        inside = model.tagger.transform_rows(rows, numbers)
        known = fe.dict_features(rows, lex, model.counts)
        joins = model.tagger.transform(rows, chosen_features(known, rows, stats, model.dict_level, model.gap_level))
        assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, inside.collect()), key=repr) == sorted(map(tuple, joins.collect()), key=repr)
        assert model.labels(rows).columns == inside.columns
