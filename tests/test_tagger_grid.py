"""The tagger levels of the grid: counts by run and inner fold, features without leakage, scores."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import crf
from spanloom.operators import evaluate as ev
from spanloom.operators.features import DICT_FEATURES, GAP_FEATURES, dict_features
from spanloom.operators.lattice import Lexicon, occ_hit
from spanloom.operators.ngrams import NgramStats
from spanloom.operators.splits import inner_folds, with_fold_roles
from spanloom.plans import experiment as ex
from spanloom.plans import tagger_grid as tg

WORDS = ["ab", "ba", "aab", "b", "a", "bbb", "cab", "c"]


@pytest.fixture(scope="module")
def grid(spark):
    rng, rows = random.Random(8), []
    for i in range(120):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(2, 8))]
        rows.append((i, "xy"[i % 2], w, ["n"] * len(w), "".join(w)))
    sent = spark.createDataFrame(rows, "sid bigint, category string, words array<string>, tags array<string>, s string")
    lex = Lexicon.build(spark.createDataFrame([(w, i % 2 == 0, False, True) for i, w in enumerate(["ab", "aab", "bbb", "ca", "cabab"])],
                                              "word string, has_yi boolean, has_yin boolean, has_book_title boolean")
                        .selectExpr("word", "length(word) AS len", "CASE length(word) WHEN 2 THEN '2' WHEN 3 THEN '3' ELSE '5P' END AS bin",
                                    "has_yi", "has_yin", "has_book_title"))
    stats = NgramStats.count(sent.selectExpr("cast(sid as string) AS rid", "s AS run"))
    roles = with_fold_roles(sent).persist()
    dealt = roles.join(inner_folds(roles).select("sid", F.col("fold").alias("inner")), "sid").persist()
    return sent, lex, stats, roles, dealt


def test_features_of_a_slot_equal_those_from_its_sentences_alone(spark, grid):
    """Test rows see the training part of their run; a row learnt from sees it without its own inner fold."""
    _, lex, stats, _, dealt = grid
    counts = tg.run_counts(dealt, lex)
    rows = tg.grid_rows(dealt, None).persist()
    made = tg.grid_features(rows, lex, counts, stats)
    got = {(r["sid"], r["pos"]): tuple(r[c] for c in DICT_FEATURES) for r in made.collect()}
    assert set(made.columns) == {"sid", "pos", *DICT_FEATURES, *GAP_FEATURES}
    for run, inner in ((0, 5), (3, 5), (0, 2), (4, 1)):
        train = dealt.where(F.element_at("in_train", run + 1))
        own = rows.where(F.col("slot") == run * 6 + inner)
        seen = train if inner == 5 else train.where(F.col("inner") != inner)
        assert own.where("learn").isEmpty() == (inner == 5) and not own.isEmpty()
        for r in dict_features(own.select("sid", "s"), lex, occ_hit(seen, lex)).collect():
            assert got[(r["sid"], r["pos"])] == pytest.approx(tuple(r[c] for c in DICT_FEATURES))


def test_rows_to_learn_from_are_bounded_by_run(grid):
    dealt = grid[4]
    rows = tg.grid_rows(dealt, 20)
    assert {r["run"]: r["count"] for r in rows.where("learn").groupBy("run").count().collect()} == {r: 20 for r in range(5)}
    assert rows.where("NOT learn").count() == 120 and rows.select("sid").distinct().count() == rows.count()
    test = {r["sid"] // 6: r["run"] for r in rows.where("NOT learn").collect()}
    assert all(test[r["sid"] // 6] != r["run"] for r in rows.where("learn").collect())


def test_grid_scores_of_all_levels(grid, monkeypatch):
    sent, lex, stats, roles, _ = grid
    names = ("crf0", "crf3", "crf8")
    counts = tg.tagger_counts(roles, lex, stats, names, max_rows=60, max_iter=25)
    # scoring by a join with the weights gives the same
    monkeypatch.setattr(tg, "BROADCAST_BYTES", 0)
    assert sorted(map(str, tg.tagger_counts(roles, lex, stats, names, max_rows=60, max_iter=25).collect())) == sorted(map(str, counts.collect()))
    scores = ex.cv_scores(roles, lex.words, ("fmm_corpus",), taggers=counts).collect()
    by = {(r["method"], r["fold"], r["category"]): r for r in scores}
    assert set(by) == {(m, f, c) for m in (*names, "fmm_corpus") for f in range(5) for c in ("x", "y", ev.ALL)}
    for (m, f, c), r in by.items():
        other = by[("fmm_corpus", f, c)]
        assert [r[k] for k in ("num_gold", "n_sents", "oov_total", "iv_total", "OOV%")] == [other[k] for k in ("num_gold", "n_sents", "oov_total", "iv_total", "OOV%")]
        assert 0 <= r["num_correct"] <= min(r["num_gold"], r["num_pred"])
    mean = {m: sum(by[(m, f, ev.ALL)]["F1"] for f in range(5)) / 5 for m in names}
    assert all(x > 0.4 for x in mean.values()), mean


def test_one_model_of_the_grid_equals_a_model_alone(spark, grid):
    """Run 1, level crf1: the same weights whether fitted with all runs and levels or alone."""
    _, lex, stats, roles, dealt = grid
    rows = tg.grid_rows(dealt, 40).where("learn").persist()
    extra = tg.grid_features(rows, lex, tg.run_counts(dealt, lex), stats).select("sid", "pos", *DICT_FEATURES).persist()
    singles = tg.run_singles(roles)
    y = F.transform(F.split("s", ""), lambda ch: F.when(ch == "a", 0).when(ch == "b", 2).otherwise(3))
    table, index = crf.training_table(rows, singles, y, extra, DICT_FEATURES)
    levels = tg.numeric_features(("crf0", "crf1", "crf5"))
    many = crf.weight_table(crf.fit_theta(table, index, 5, DICT_FEATURES, levels, 4, max_iter=40), index, DICT_FEATURES)
    theta = crf.fit_theta(table.where("run = 1").withColumn("run", F.lit(0)), index, 1, DICT_FEATURES, [levels[1]], 4, max_iter=40)
    alone = crf.weight_table(theta, index, DICT_FEATURES)
    got = {r["feature"]: list(r["w"])[4:8] for r in many.where("run = 1").collect()}
    want = {r["feature"]: list(r["w"]) for r in alone.collect()}
    for f in set(got) | set(want):
        assert got.get(f, [0.0] * 4) == pytest.approx(want.get(f, [0.0] * 4), abs=0.05), f
