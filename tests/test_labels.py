import random
import re

from pyspark.sql import functions as F

from spanloom.functions import labels as lab
from spanloom.functions.script import SCRIPT_RANGES_STATS, characters, chunk_runs, script_class, script_runs


# Worked by hand: characters, labels, words.
TOLERANT = [
    ("", "", []), ("ab", "SS", ["a", "b"]), ("abc", "BIE", ["abc"]), ("abc", "BIS", ["ab", "c"]), ("abc", "BBE", ["a", "bc"]),
    ("ab", "EE", ["a", "b"]), ("abc", "IIE", ["abc"]), ("abcd", "SIES", ["a", "bc", "d"]), ("ab", "BI", ["ab"]), ("abc", "BSE", ["a", "b", "c"]),
]
STRICT = [
    ("", "", []), ("abc", "B-n I-n E-v", [("abc", "v")]), ("abc", "B-n S-v E-n", [("b", "v"), ("ac", "n")]), ("ab", "B-n B-v", [("b", "v")]),
    ("ab", "E-n E-v", [("a", "n"), ("b", "v")]), ("a", "I-n", [("a", "")]), ("ab", "S-v-x S-n", [("a", "v-x"), ("b", "n")]), ("ab", "B-n I-v", [("ab", "n")]),
]


def test_documented_example(spark):
    df = spark.createDataFrame([(["我", "喜欢", "吃", "苹果"], ["r", "v", "v", "n"])], "w array<string>, t array<string>")
    row = df.select(lab.words_to_bies(F.col("w")).alias("y"), lab.words_tags_to_joint(F.col("w"), F.col("t")).alias("j")).first()
    assert row["y"] == list("SBESBE")
    assert row["j"] == ["S-r", "B-v", "E-v", "S-v", "B-n", "E-n"]


def test_decoders_on_worked_cases(spark):
    df = spark.createDataFrame([(s, list(y)) for s, y, _ in TOLERANT], "s string, y array<string>")
    got = {(r["s"], "".join(r["y"])): r["w"] for r in df.select("s", "y", lab.bies_to_words(characters(F.col("s")), F.col("y")).alias("w")).collect()}
    assert got == {(s, y): w for s, y, w in TOLERANT}
    df = spark.createDataFrame([(s, y.split()) for s, y, _ in STRICT], "s string, y array<string>")
    got = {(r["s"], " ".join(r["y"])): [tuple(x) for x in r["p"]]
           for r in df.select("s", "y", lab.joint_to_words_tags(characters(F.col("s")), F.col("y")).alias("p")).collect()}
    assert got == {(s, y): p for s, y, p in STRICT}


def test_any_labels_spell_the_text_and_end_words_where_they_must(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abc") for _ in range(n)), [rng.choice("BIES") for _ in range(n)]) for n in (rng.randint(0, 9) for _ in range(200))]
    df = spark.createDataFrame(rows, "s string, y array<string>")
    for r in df.select("s", "y", lab.bies_to_words(characters(F.col("s")), F.col("y")).alias("w")).collect():
        y = "".join(r["y"])
        assert "".join(r["w"]) == r["s"]
        ends = {len("".join(r["w"][:i + 1])) for i in range(len(r["w"]))}
        assert ends == {m.end() for m in re.finditer(r"[ES]|.(?=[BS]|$)", y)}


def test_round_trip_and_transitions(spark, make_sent):
    rng = random.Random(2)
    sents = [["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6))] for _ in range(100)]
    df = make_sent(sents)
    y = lab.words_to_bies(F.col("words"))
    rows = df.select("words", lab.bies_to_words(characters(F.col("s")), y).alias("w"), lab.illegal_transitions(y).alias("bad")).collect()
    assert all(r["words"] == r["w"] and r["bad"] == 0 for r in rows)


def test_script_runs_and_chunks(spark):
    text = "x𗀀𗀁,𗀂" + "𗀀" * 300
    df = spark.createDataFrame([(1, text)], "id int, text string")
    runs = df.select("id", F.explode(script_runs(F.col("text"), script_class(SCRIPT_RANGES_STATS))).alias("run"))
    assert [len(r["run"]) for r in runs.collect()] == [2, 301]
    chunks = chunk_runs(runs, "run").orderBy("piece").collect()
    assert [len(r["chunk"]) for r in chunks] == [128, 128, 45]
