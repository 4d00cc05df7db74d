import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spanloom.operators import features as fe
from spanloom.operators import lattice as la


def lexicon(spark, words):
    df = spark.createDataFrame([(w, i % 2 == 0) for i, w in enumerate(sorted(words))], "word string, has_yi boolean")
    df = df.withColumn("bin", la.length_bin(F.length("word"))).withColumn("has_yin", F.lit(False)).withColumn(
        "has_book_title", F.lit(False))
    return la.Lexicon.build(df)


def brute(s, words):
    return sorted((i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if s[i:j] in words)


@pytest.fixture(scope="module")
def data(make_sent):
    rng = random.Random(3)

    def word(n):
        return "".join(rng.choice("ab") for _ in range(n))

    words = {word(rng.randint(2, 4)) for _ in range(8)} | {word(n) for n in (5, 7, 9, 12)} | {"ab" * 20}
    sents = [[word(rng.randint(1, 5)) for _ in range(rng.randint(1, 8))] for _ in range(40)]
    sents.append(["ab" * 20, "b"] + [word(6) for _ in range(150)])  # longer than a block
    return words, sents, make_sent(sents)


@pytest.mark.parametrize("fits", [True, False])
@pytest.mark.parametrize("many", [20_000, 0])
def test_matches_equal_brute_force(spark, data, monkeypatch, fits, many):
    """Broadcast and salted joins, short and long stems, long words, long texts."""
    words, sents, sent = data
    monkeypatch.setattr(la, "MANY_WORDS", many)
    lex = replace(lexicon(spark, words), fits=fits)
    got = la.lattice(sent, lex).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("m")).collect()
    got = {r["sid"]: [tuple(x) for x in r["m"]] for r in got}
    for i, w in enumerate(sents):
        assert got.get(i, []) == brute("".join(w), words)


@pytest.mark.parametrize("fits", [True, False])
@pytest.mark.parametrize("every", [True, False])
def test_words_beyond_the_near_reach(spark, make_sent, monkeypatch, fits, every):
    monkeypatch.setattr(la, "NEAR", 6)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ab") for _ in range(n))
    sents = [[text(rng.randint(1, 40)) for _ in range(rng.randint(1, 30))] for _ in range(20)]
    whole = ["".join(w) for w in sents]
    words = {s[i:i + n] for s in whole for i, n in ((0, 3), (3, 6), (5, 7), (9, 20), (2, 400)) if len(s[i:i + n]) > 1}
    lex = replace(lexicon(spark, words), fits=fits)
    assert lex.max_len > lex.near
    rows = la.lattice(make_sent(sents), lex, keep=("category",), gold="words", every_position=every).where("found").collect()
    got = sorted((r["sid"], r["start"], r["stop"]) for r in rows)
    assert got == sorted((i, a, b) for i, s in enumerate(whole) for a, b in brute(s, words))
    gold = [spans(w) for w in sents]
    assert all(r["is_gold"] == ((r["start"], r["stop"]) in gold[r["sid"]]) and r["word"] == whole[r["sid"]][r["start"]:r["stop"]] for r in rows)


def test_a_very_long_word_in_a_very_long_sentence(spark, make_sent):
    """Copying the reach at every position would take 5 GB here."""
    rng = random.Random(9)
    s = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    words = {s[20_000:70_000], s[10:310], "ab"}
    rows = la.lattice(make_sent([[s]]), lexicon(spark, words)).select("start", "stop").collect()
    pairs = [(i, i + 2) for i in range(len(s) - 1) if s[i:i + 2] == "ab"]
    assert sorted(map(tuple, rows)) == sorted([*pairs, (20_000, 70_000), (10, 310)])


def spans(words):
    out, at = set(), 0
    for w in words:
        out.add((at, at + len(w)))
        at += len(w)
    return out


def test_occ_hit_and_reliability(spark, data):
    words, sents, sent = data
    counts = la.occ_hit(sent, lexicon(spark, words))
    got = {r["word"]: (r["occ"], r["hit"]) for r in counts.collect()}
    want = {}
    for w in sents:
        s, gold = "".join(w), spans(w)
        for a, b in brute(s, words):
            o, h = want.get(s[a:b], (0, 0))
            want[s[a:b]] = (o + 1, h + ((a, b) in gold))
    assert got == want
    priors = {r["bin"]: r["p_g"] for r in la.class_priors(counts).collect()}
    assert set(priors) == set(la.BINS)
    for r in la.reliability(counts).collect():
        assert r["value"] == pytest.approx((r["hit"] + 5 * r["p_g"]) / (r["occ"] + 5))


def test_priors_without_occurrences(spark):
    empty = spark.createDataFrame([], "word string, bin string, occ bigint, hit bigint")
    assert {r["bin"]: r["p_g"] for r in la.class_priors(empty).collect()} == {b: 0.5 for b in la.BINS}


def feature_rows(df):
    return {(r["sid"], r["pos"]): tuple(round(r[n], 9) for n in fe.DICT_FEATURES) for r in df.collect()}


def test_every_position_has_features(spark, data):
    words, sents, sent = data
    lex = lexicon(spark, words)
    rows = feature_rows(fe.dict_features(sent, lex, la.occ_hit(sent, lex)))
    assert len(rows) == sum(len("".join(w)) for w in sents)
    for i, w in enumerate(sents[:10]):
        m = brute("".join(w), words)
        for pos in range(len("".join(w))):
            assert rows[(i, pos)][0] == float(any(a == pos and b - a == 2 for a, b in m))  # B2
            assert rows[(i, pos)][10] == float(any(b - 1 == pos and b - a >= 5 for a, b in m))  # E5P
    without = feature_rows(fe.dict_features(sent, lex, None))
    assert all(v[11:17] == (0.0,) * 6 for v in without.values())


def test_out_of_fold_features_do_not_leak(spark, data, make_sent):
    """Moving the gold boundaries of one fold changes nothing for its own sentences."""
    words, sents, sent = data
    lex = lexicon(spark, words)
    folds = sent.select("sid", F.pmod("sid", F.lit(5)).cast("int").alias("fold"))
    changed = make_sent([list("".join(w)) if i % 5 == 2 else w for i, w in enumerate(sents)])
    a = feature_rows(fe.oof_dict_features(sent, lex, folds=folds))
    b = feature_rows(fe.oof_dict_features(changed, lex, folds=folds))
    assert {k: v for k, v in a.items() if k[0] % 5 == 2} == {k: v for k, v in b.items() if k[0] % 5 == 2}
    assert a != b


def test_out_of_fold_equals_training_on_the_other_folds(spark, data):
    words, _, sent = data
    lex = lexicon(spark, words)
    folds = sent.select("sid", F.pmod("sid", F.lit(5)).cast("int").alias("fold"))
    oof = feature_rows(fe.oof_dict_features(sent, lex, folds=folds))
    rest, own = sent.where("sid % 5 <> 1"), sent.where("sid % 5 = 1")
    direct = feature_rows(fe.dict_features(own, lex, la.occ_hit(rest, lex)))
    assert direct == {k: v for k, v in oof.items() if k[0] % 5 == 1}
