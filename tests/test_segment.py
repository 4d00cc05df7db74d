import itertools
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from spanloom.api import DictionarySegmenter, DictionarySegmenterModel, SegmentationEvaluator, TaggerSegmenter, TaggerSegmenterModel
from spanloom.functions.labels import BIES, LEGAL_END, LEGAL_NEXT, LEGAL_START
from spanloom.operators import segment as sg
from spanloom.operators.evaluate import spans_of
from spanloom.operators.lattice import Lexicon
from spanloom.operators.ngrams import NgramStats
from spanloom.operators.tagger import CharTagger


def forward(s, words):
    out, i = [], 0
    longest = max(map(len, words))
    while i < len(s):
        n = next((n for n in range(min(longest, len(s) - i), 0, -1) if s[i:i + n] in words), 1)
        out.append(s[i:i + n])
        i += n
    return out


def backward(s, words):
    return [w[::-1] for w in forward(s[::-1], {w[::-1] for w in words})][::-1]


# Worked by hand: lexicon, text, result of the bidirectional choice.
CHOICES = [
    (["ab", "abc", "bcd", "d"], "abcd", ["abc", "d"]),                # backward leaves "a" unknown
    (["abc", "bcd", "a"], "abcd", ["a", "bcd"]),                      # forward leaves "d" unknown
    (["ab", "cd", "e", "bcde", "a"], "abcde", ["ab", "cd", "e"]),     # none unknown: three words beat two
    (["abcd", "e", "de", "bc", "a"], "abcde", ["a", "bc", "de"]),     # the same from the other side
    (["ab", "c", "a", "bc"], "abc", ["ab", "c"]),                     # a tie goes forward
]


def test_bidirectional_choice(spark):
    for words, s, want in CHOICES:
        lex = Lexicon.build(spark.createDataFrame([(w,) for w in words], "word string"))
        assert sg.max_match(spark.createDataFrame([(1, s)], "sid bigint, s string"), lex).first()["bidirectional"] == want


def test_maximum_matching_equals_its_definition(spark, make_sent):
    rng = random.Random(5)
    words = {"".join(rng.choice("xyz") for _ in range(rng.randint(1, 7))) for _ in range(25)} - {"z"}
    sents = [["".join(rng.choice("xyzw") for _ in range(rng.randint(1, 25)))] for _ in range(150)]
    lex = Lexicon.build(spark.createDataFrame([(w,) for w in words], "word string"))
    rows = sg.max_match(make_sent(sents), lex, sg.MODES).collect()
    assert len(rows) == len(sents)
    for r in rows:
        s = sents[r["sid"]][0]
        assert r["fmm"] == forward(s, words) and r["bmm"] == backward(s, words) and r["bidirectional"] in (r["fmm"], r["bmm"])
        assert "".join(r["bidirectional"]) == s


def test_long_sentences_are_matched_and_measured_in_blocks(spark, make_sent):
    rng = random.Random(11)
    words = {"".join(rng.choice("xyz") for _ in range(rng.randint(1, 5))) for _ in range(25)}
    sents = [["".join(rng.choice("xyzw") for _ in range(n))] for n in (255, 256, 257, 1000, 20_000)]
    lex = Lexicon.build(spark.createDataFrame([(w,) for w in words], "word string"))
    for r in sg.max_match(make_sent(sents), lex, sg.MODES).collect():
        s = sents[r["sid"]][0]
        assert r["fmm"] == forward(s, words) and r["bmm"] == backward(s, words)
    many = [["w" * rng.randint(1, 3) for _ in range(n)] for n in (0, 1, 255, 256, 257, 100_000)]
    for r in make_sent(many).select("sid", spans_of(F.col("words")).alias("at")).collect():
        stops = list(itertools.accumulate(map(len, many[r["sid"]])))
        assert [tuple(x) for x in r["at"]] == list(zip([0, *stops][:len(stops)], stops))


def test_dictionary_sources(spark):
    corpus, extra = (spark.createDataFrame([(w,) for w in ws], "word string") for ws in (["ab", "abc"], ["abcde"]))
    words = sg.dictionary_words("combined", corpus, extra)
    assert words.where("in_source").count() == 3 and words.count() == 3 + 36
    assert sg.max_word_length(words).first()[0] == 5
    with pytest.raises(ValueError):
        sg.dictionary_words("other", corpus, extra)


def best_path(scores, start, trans, end):
    def total(path):
        t = start[path[0]] + scores[0][path[0]]
        for i in range(1, len(path)):
            t = t + trans[path[i - 1]][path[i]] + scores[i][path[i]]
        return t + end[path[-1]]

    def legal(path):
        labs = [BIES[i] for i in path]
        return labs[0] in LEGAL_START and labs[-1] in LEGAL_END and all(b in LEGAL_NEXT[a] for a, b in zip(labs, labs[1:]))

    paths = [p for p in itertools.product(range(4), repeat=len(scores)) if legal(p)]
    return max(paths, key=total)


def test_viterbi_equals_enumeration(spark):
    rng = random.Random(7)
    num = lambda: rng.random() * 4
    start, end, trans = [num() for _ in range(4)], [num() for _ in range(4)], [[num() for _ in range(4)] for _ in range(4)]
    rows = [(i, [[num() for _ in range(4)] for _ in range(rng.randint(1, 5))]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, e array<array<double>>")
    lit = lambda xs: [F.lit(x) for x in xs]
    got = df.select("i", sg.viterbi(F.col("e"), lit(start), [lit(t) for t in trans], lit(end)).alias("y")).collect()
    for r in got:
        assert r["y"] == [BIES[k] for k in best_path(rows[r["i"]][1], start, trans, end)]


def test_fit_transform_save_load(spark, make_sent, tmp_path):
    train = make_sent([["foo", "bar"], ["foo", "b"], ["ba", "r"]])
    model = DictionarySegmenter("fmm").fit(train)
    model.save(str(tmp_path / "m"))
    loaded = DictionarySegmenterModel.load(spark, str(tmp_path / "m"))
    raw = spark.createDataFrame([(1, "foobarq")], "sid bigint, s string")
    for m in (model, loaded):
        row = m.transform(raw).first()
        assert row["pred_words"] == ["foo", "bar", "q"] and row["pred_tags"] == ["n", "n", "x"]


def test_character_tagger_learns_and_restores(spark, make_sent, tmp_path):
    train = make_sent([["ab", "c"], ["c", "ab"], ["ab", "ab", "c"]] * 10)
    tagger = CharTagger.fit(train, n_features=1 << 10, max_iter=30)
    tagger.save(str(tmp_path / "t"))
    raw = spark.createDataFrame([(1, "cabcab")], "sid bigint, s string")
    for t in (tagger, CharTagger.load(spark, str(tmp_path / "t"))):
        assert t.transform(raw).first()["pred_words"] == ["c", "ab", "c", "ab"]


def test_tagger_contract_with_features(spark, make_sent, tmp_path):
    rng = random.Random(3)
    train = make_sent([[rng.choice(["ab", "c", "abc", "da"]) for _ in range(4)] for _ in range(80)])
    lex = Lexicon.build(spark.createDataFrame([("ab", "2", True, False, False), ("abc", "3", False, True, False)],
                                              "word string, bin string, has_yi boolean, has_yin boolean, has_book_title boolean"))
    stats = NgramStats.count(train.select(F.col("s").alias("run")))
    model = TaggerSegmenter(lex, stats, n_features=1 << 10, max_iter=20).fit(train)
    assert len(model.tagger.numeric) == 28
    model.save(str(tmp_path / "f"))
    raw = spark.createDataFrame([(1, "cabcda"), (2, ""), (3, None)], "sid bigint, s string")
    outs = [{r["sid"]: (r["pred_words"], r["pred_tags"]) for r in m.transform(raw).collect()}
            for m in (model, TaggerSegmenterModel.load(spark, str(tmp_path / "f")))]
    assert outs[0] == outs[1] and outs[0][2] == outs[0][3] == ([], [])
    assert "".join(outs[0][1][0]) == "cabcda" and len(outs[0][1][0]) == len(outs[0][1][1])
    with pytest.raises(ValueError):
        TaggerSegmenter()


def test_pipeline_and_cross_validation(spark, make_sent, tmp_path):
    rng = random.Random(4)
    words = ["ab", "abc", "cd", "de", "x", "bcd"]
    sent = make_sent([rng.choices(words, k=8) for _ in range(40)])
    extra = spark.createDataFrame([("abcdex",)], "word string")
    est = DictionarySegmenter("fmm", "corpus", extra)
    grid = ParamGridBuilder().addGrid(est.mode, ["fmm", "bmm"]).addGrid(est.source, ["predefined", "combined"]).build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=SegmentationEvaluator("F1"), numFolds=2, seed=1).fit(sent)
    best = max(range(4), key=lambda i: cv.avgMetrics[i])
    assert grid[best][est.source] == "combined" and cv.bestModel.mode == grid[best][est.mode]
    model = Pipeline(stages=[est]).fit(sent)
    want = sorted(map(str, model.transform(sent).collect()))
    model.write().overwrite().save(str(tmp_path / "p"))
    assert sorted(map(str, PipelineModel.load(str(tmp_path / "p")).transform(sent).collect())) == want
    for bad in (dict(mode="none"), dict(source="none"), dict(source="combined")):
        with pytest.raises(ValueError):
            DictionarySegmenter(**bad)


def test_a_broken_save_leaves_the_old_model(spark, make_sent, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    old = DictionarySegmenter("fmm").fit(make_sent([["ab", "c"]]))
    new = DictionarySegmenter("bmm").fit(make_sent([["a", "bc"]]))
    old.save(path)
    with pytest.raises(FileExistsError):
        new.write().save(path)
    with monkeypatch.context() as m:
        m.setattr(type(new.tags), "sparkSession", property(lambda _: 1 / 0))
        with pytest.raises(ZeroDivisionError):
            new.save(path)
    assert DictionarySegmenterModel.load(path).mode == "fmm"
    new.save(path)
    loaded = DictionarySegmenterModel.load(spark, path)
    assert loaded.mode == "bmm" and {r["word"] for r in loaded.lex.words.collect()} >= {"a", "bc"}
    with pytest.raises(FileNotFoundError):
        DictionarySegmenterModel.load(str(tmp_path / "none"))
