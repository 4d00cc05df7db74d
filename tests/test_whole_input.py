"""Nothing is cut or lost: long lexicon words, empty sentences, null categories, one shared folder."""

import pytest

from spanloom.api import DictionarySegmenter
from spanloom.operators import evaluate as ev
from spanloom.session import shared_dir
from spanloom.sources.corpus import Corpus


def test_lexicon_words_have_no_longest_length(spark, tmp_path):
    long = "abcdefghijklmnopqrstuvwxyz"
    spark.createDataFrame([(1, f"{long} ab a")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, f"{long} zz", "en", "s")], "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert {r["word"] for r in Corpus(spark, str(tmp_path)).lex_words.collect()} == {long, "ab"}


def test_transform_returns_every_row(spark, make_sent):
    model = DictionarySegmenter().fit(make_sent([["ab", "c"], ["c"]]))
    rows = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "sid bigint, s string")
    out = {r["sid"]: (r["pred_words"], r["pred_tags"]) for r in model.transform(rows).collect()}
    assert out == {1: (["ab", "c"], ["n", "n"]), 2: ([], []), 3: ([], [])}


def test_a_null_category_is_no_second_total(spark):
    names = ["gold", "pred", "correct", "tag_ok", "sents"]
    rows = spark.createDataFrame([("en", True, 3, 3, 2, 2, 1), (None, True, 5, 4, 1, 1, 1)], "category string, iv boolean, " + ", ".join(f"{n} bigint" for n in names))
    out = {r["category"]: r["num_gold"] for r in ev.totals(rows, (), "category").collect()}
    assert out == {"en": 3, ev.NO_CATEGORY: 5, ev.ALL: 8}


def test_a_cluster_without_shared_folder_is_an_error(monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
