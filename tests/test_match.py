import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import features as fe
from spanloom.operators import lattice as la
from spanloom.operators import match
from spanloom.operators import segment as sg
from spanloom.operators.ngrams import NgramStats
from spanloom.sources.corpus import Corpus, cut_tokens


@pytest.fixture(scope="module")
def data(spark, make_sent):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abß\U00018800") for _ in range(n))
    sents = [[word(rng.randint(1, 5)) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    words = sorted({w for s in sents[::2] for w in s} | {word(n) for n in (6, 9, 30)} | {"a"})
    df = spark.createDataFrame([(w, i % 2 == 0, i % 3 == 0, i % 5 == 0) for i, w in enumerate(words)],
                               "word string, has_yi boolean, has_yin boolean, has_book_title boolean")
    return sents, la.Lexicon.build(df.withColumn("bin", la.length_bin(F.length("word")))), make_sent(sents)


def both(monkeypatch, make):
    """Rows made inside the sentence, and by the joins that a list too large for a broadcast takes."""
    inside = sorted(map(tuple, make().collect()), key=repr)
    monkeypatch.setattr(match, "MAX_BYTES", -1)
    return inside, sorted(map(tuple, make().collect()), key=repr)


def test_counts_spans_features_and_segments_equal_the_joins(monkeypatch, data):
    sents, lex, sent = data
    for make in (lambda: la.occ_hit(sent, lex).select("word", "bin", "occ", "hit"), lambda: la.sentence_spans(sent, lex),
                 lambda: fe.dict_features(sent, lex, la.occ_hit(sent, lex), unique=True), lambda: sg.max_match(sent, lex, sg.MODES)):
        with monkeypatch.context() as m:
            inside, joins = both(m, make)
        assert inside and inside == joins


def test_sums_made_in_the_row_equal_those_of_the_positions(spark, data):
    sents, lex, sent = data
    stats = NgramStats.count(spark.createDataFrame([("".join(s),) for s in sents[:20]], "run string"))
    counts, folded = la.occ_hit(sent, lex), sent.withColumn("fold", (F.col("sid") % 5).cast("int"))
    shares = la.Lexicon.build(lex.words.select("word", F.lit(0.25).alias("share_a"), F.lit(0.75).alias("share_b")))
    for make in (lambda **k: fe.bie_features(sent, lex, True, **k), lambda **k: fe.meta_features(sent, lex, True, **k),
                 lambda **k: fe.dict_features(sent, lex, counts, unique=True, **k), lambda **k: fe.gap_features(sent, stats, True, **k),
                 lambda **k: fe.oof_dict_features(sent, lex, folds=folded.select("sid", "fold"), unique=True, **k)):
        rows = make()
        names = [c for c in rows.columns if c not in ("sid", "pos")]
        want = {r["sid"]: r for r in fe._summed(rows, names, "place").collect()}
        summed = make(sums="place")
        plan = summed._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(sid" not in plan or "fold" in plan
        got = {r["sid"]: r for r in summed.collect()}
        assert got.keys() == want.keys() and all(got[s][n] == pytest.approx(want[s][n]) for s in got for n in names)
        total, parts = fe._summed(rows, names, "all").first(), make(sums="all").collect()
        assert all(sum(p[n] for p in parts) == pytest.approx(total[n]) for n in [*names, *[f"n:{n}" for n in names]])
    in_a = F.col("category") == "en"
    want = {r["sid"]: tuple(r) for r in fe._domain_sums(fe.domain_features(sent, shares, in_a, True), "place").collect()}
    assert {r["sid"]: tuple(r) for r in fe.domain_features(sent, shares, in_a, True, "place").collect()} == want


def test_tags_of_words_are_made_in_the_row(spark, data):
    sents, lex, sent = data
    modal = spark.createDataFrame([("a", "x1"), ("b", "y"), ("c", None)], "word string, tag string")
    rows = sg.tag_arrays(sent.select("sid", "words"), modal, "words").collect()
    assert all(r["pred_tags"] == [{"a": "x1", "b": "y"}.get(w, "x") for w in r["words"]] for r in rows) and len(rows) == len(sents)


def test_gaps_in_the_row_equal_those_by_lag(data, spark):
    sents, lex, sent = data
    stats = NgramStats.count(spark.createDataFrame([("".join(s),) for s in sents[:20]], "run string"))
    a, b = (sorted(map(tuple, fe.gap_features(sent, stats, unique).select("sid", "pos", *fe.GAP_FEATURES).collect())) for unique in (True, False))
    assert len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b))


def test_nothing_is_shuffled_by_character_and_sentences_are_not_kept(spark, data, tmp_path):
    sents, lex, sent = data
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(sg.max_match(sent, lex, sg.MODES)) and "Exchange" not in plan(fe.bie_features(sent, lex, True))
    rows = [(i, "Ab c 1 " * 40, "en", "s") for i in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = Corpus(spark, str(tmp_path))
    assert c.unique and "InMemory" not in plan(c.sent).replace("InMemoryFileIndex", "") and "hashpartitioning(sid" not in plan(c.sent)
    assert [len(r["words"]) for r in c.sent.where("doc_id = 3").orderBy("k").collect()] == [12] * 10
    assert cut_tokens(spark.createDataFrame([(1, [])], "i int, t array<string>"), "t").count() == 0
