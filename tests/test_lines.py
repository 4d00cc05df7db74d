from pyspark.sql import functions as F

from spanloom.functions import lines as ln
from spanloom.sources.readers import parse_lines, read_tagged_corpus

LINE1 = "68.1.1 𘴈/a  𘏨/a  𗉋/a  𗖰𗚩/n  𘐳/q  𗤁𗰗𘉋/m"
LINE2 = "68.1.2 𘋢𗥤/n  𘞌/a  𘟀/v  𗡪mo"
LINE3 = "03.03.12 𗤒/n  𗅁/t  𘙇/Dir1.  𘃡/Erg. 𗞝/a"
LINES = [
    LINE1, LINE2, LINE3, "   ", "19980101-01-001-001/m 新华社/nt 记者/n 报道/v", "1.1.1 [a/n b/v]nz c/vc!2 d/x^y",
    "1.1.1 𗅔v 𗅕n 𗅖a 𗅗/d", "a/n b/v c/q", "1.1.1 nothing here at all", "2.2.2 1.2.3/m a/n b/n c/n",
]


def parsed(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string")
    return {r["i"]: r for r in parse_lines(df).collect()}


def test_sample_lines(spark):
    rows = parsed(spark)
    assert rows[0]["words"] == ["𘴈", "𘏨", "𗉋", "𗖰𗚩", "𘐳", "𗤁𗰗𘉋"]
    assert rows[0]["tags"] == list("aaanqm") and rows[0]["category"] == "scripture"
    assert rows[0]["line_id"] == "68.1.1"
    assert rows[1]["words"] == ["𘋢𗥤", "𘞌", "𘟀"]  # the last token has no slash
    assert rows[2]["category"] == "secular" and rows[2]["tags"] == ["n", "t", "Dir1.", "Erg.", "a"]


def test_grammar(spark):
    rows = parsed(spark)
    assert 3 not in rows  # blank
    assert rows[4]["words"] == ["新华社", "记者", "报道"] and rows[4]["category"] == "unknown"
    assert list(zip(rows[5]["words"], rows[5]["tags"])) == [("a", "n"), ("b", "v"), ("c", "vc"), ("d", "x")]
    assert list(zip(rows[6]["words"], rows[6]["tags"])) == [("𗅔", "v"), ("𗅕", "n"), ("𗅖", "a"), ("𗅗", "d")]
    assert rows[7]["category"] == "unknown" and rows[7]["tags"] == ["n", "v", "q"]
    # Pure letters split into one character and a tag when tokens are recovered.
    assert rows[8]["words"] == ["n", "h", "a", "a"]
    assert rows[9]["words"] == ["a", "b", "c"]


def test_tag_normal_forms(spark):
    tags = ["Quet", "Obj", "Dir1,", "mc.", " n ", "?", "", "Loc."]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    assert [r[0] for r in df.select(ln.normalize_tag(F.col("t"))).collect()] == [
        "Quot.", "Obj.", "Dir1.", "mc", "n", None, None, "Loc."]


def test_reader_keeps_line_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"68.1.{i} w{i}/n" for i in range(50)), encoding="utf-8")
    rows = read_tagged_corpus(spark, str(tmp_path), max_sentences=7).orderBy("at").collect()
    assert [r["words"] for r in rows] == [[f"w{i}"] for i in range(7)]
    assert read_tagged_corpus(spark, str(tmp_path)).count() == 50
