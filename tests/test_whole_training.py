"""Taggers learn from all their training sentences, and blocks give the sums of their sentences."""

import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.catalog import segment_queries as sq
from spanloom.catalog.split_queries import part
from spanloom.operators import crf
from spanloom.operators.splits import with_fold_roles
from spanloom.plans import tagger_grid as tg
from spanloom.sources.corpus import Corpus


def test_block_sums_equal_those_of_sentences():
    rng = np.random.default_rng(3)
    for levels, labels in ((1, 4), (3, 4), (1, 7)):
        sizes = rng.integers(0, 9, 40)
        n, numeric = int(sizes.sum()), 5
        ids = rng.integers(-1, 30, (n, 11))
        dense, y = (rng.random((n, numeric)) < 0.3) * 1.5, rng.integers(0, labels, n)
        theta = rng.standard_normal((30 + numeric + labels, levels, labels))
        for groups in ([[0, 1, 2, 3, 4]], [[0, 4], [1, 2], [3]]):
            block = crf.Block.of(ids, dense, y, sizes, groups)
            for got, want in zip(block.sums(theta), crf.loss_and_gradient(theta, ids, dense, y, sizes)):
                assert np.allclose(got, want)
            seen = block.observed(30, numeric, labels)
            for f, label in ((0, 0), (7, 2), (29, 3)):
                assert seen[f, label] == any(f in row for row in ids[y == label])
            assert seen[31, 1] == bool((dense[y == 1, 1] != 0).any()) and seen[-labels:].all()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("whole")), random.Random(2)
    words = ["ab", "ba", "aab", "b", "abba", "bab"]
    texts = [" ".join(rng.choice(words) for _ in range(1200)) for _ in range(30)]  # 3,000 sentences
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    write([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string", "documents")
    write([(1, "ab aab bab")], "item_id bigint, text string", "benchmark")
    write([(1, 1, 0)], "doc_id bigint, quality int, toxic int", "labels")
    write([(1, 0, "user", "ab bab abba")], "conv_id bigint, turn bigint, role string, text string", "conversations")
    return Corpus(spark, path)


@pytest.fixture
def learnt(monkeypatch):
    """Sentences by run that reach the optimiser, which is left out."""
    found = {}

    def fit(rows, index, runs, numeric, levels, labels, *args, **kwargs):
        for r in rows.collect():
            found[r["run"]] = found.get(r["run"], 0) + int(pickle.loads(r["block"]).active[0])
        return np.zeros((runs, index.count() + len(numeric) + labels, len(levels), labels))

    monkeypatch.setattr(crf, "fit_theta", fit)
    return found


def test_the_character_tagger_learns_from_all_training_sentences(corpus, learnt):
    test = part(corpus, "test").count()
    assert sq.o79(corpus).count() == test
    assert learnt == {0: part(corpus, "train").count()} and learnt[0] > 2000


def test_the_grid_learns_from_all_training_sentences_of_a_run(corpus, learnt):
    roles = with_fold_roles(corpus.sent)
    want = {r: roles.where(F.element_at("in_train", r + 1)).count() for r in range(5)}
    sq.scores_of(corpus)
    assert learnt == want and min(want.values()) > 2000


def test_features_made_in_the_row_equal_those_of_the_training_table(spark, make_sent):
    rng = random.Random(6)
    sent = make_sent([["".join(rng.choice("ab1-") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 6))] for _ in range(30)])
    rows = sent.withColumn("run", (F.col("sid") % 2).cast("int"))
    singles = spark.createDataFrame([("a", [True, False]), ("1", [True, True])], "ch string, in_run array<boolean>")
    y = tg.label_numbers()
    table, index = crf.training_table(rows, singles, y, None, (), runs=2)
    blocks, same, _ = crf.training_blocks(rows, y, [["a", "1"], ["1"]], None, ())
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, same.collect()))
    theta = np.random.default_rng(1).standard_normal((2, index.count() + 4, 2, 4))
    wanted = np.ones((2, 2), bool)
    for got, want in zip(crf.evaluator(blocks, 2, 0)(theta, wanted), crf.evaluator(table, 2, 0)(theta, wanted)):
        assert np.allclose(got, want)
