import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.api import DictionarySegmenter
from spanloom.operators import embed, ngrams
from spanloom.operators.vocab import modal_tag, tag_statistics
from spanloom.session import shared_dir
from spanloom.sources import corpus, readers
from spanloom.streaming.vocabulary import incremental_word_freq, segments, stream_words


def test_lexicon_array_file(spark, tmp_path):
    entries = [
        {"xixia_character": "𗀀", "term_list": [
            {"term_character": "𗀀𗀁", "shiyi": [{"type": "音", "shiyi": "x"}]},
            {"term_character": " 𗀀𗀁 ", "shiyi": [{"type": "義", "shiyi": "《书名》"}]}, {"term_character": "𗀂", "shiyi": []}]},
        {"xixia_character": " ", "term_list": [{"term_character": "𗀂𗀃𗀄"}]}, {"xixia_character": "𗀅"},
    ]
    path = tmp_path / "lex.json"
    path.write_text(json.dumps(entries, ensure_ascii=False), encoding="utf-8")
    raw = readers.read_lexicon_json(spark, str(path))
    terms = {r["word"]: (r["has_yi"], r["has_yin"], r["has_book_title"]) for r in readers.lexicon_terms(raw).collect()}
    assert terms == {"𗀀𗀁": (True, False, True), "𗀂𗀃𗀄": (False, False, False)}
    assert {r["word"] for r in readers.lexicon_vocabulary(raw).collect()} == {"𗀀", "𗀅", "𗀀𗀁", "𗀂𗀃𗀄"}


def test_records_and_second_source(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"uuid": "a", "originalText": "t"}, {"uuid": "b", "originalText": ""}, {"uuid": "c"}]))
    assert [r["uuid"] for r in readers.read_records(spark, str(tmp_path / "r.json")).collect()] == ["a"]
    (tmp_path / "s.json").write_text(json.dumps([{"同音重校本": {"词": " 𗀀𗀁 "}}, {"同音重校本": {}}, {}], ensure_ascii=False), encoding="utf-8")
    assert [r["word"] for r in readers.read_second_source(spark, str(tmp_path / "s.json")).collect()] == ["𗀀𗀁"]


def test_ngram_statistics_by_hand(spark, tmp_path):
    runs = spark.createDataFrame([("abab",), ("ba",), ("c",)], "run string")
    stats = ngrams.NgramStats.count(runs)
    stats.save(str(tmp_path / "n"))
    for s in (stats, ngrams.NgramStats.load(spark, str(tmp_path / "n"))):
        pairs = {(r["a"], r["b"]): r for r in s.pairs.collect()}
        assert {k: r["cnt"] for k, r in pairs.items()} == {("a", "b"): 2, ("b", "a"): 2}
        assert pairs["a", "b"]["assoc"] == pytest.approx(max(0.0, math.log(1.5) - 2 * math.log(3) + math.log(4)))
    with pytest.raises(ValueError):
        ngrams.association("other")


def test_statistics_grow_by_batches(spark, tmp_path):
    runs = spark.createDataFrame([("abab",), ("ba",), ("c",), ("abc",)], "run string")
    path = str(tmp_path / "n")
    for name, part in (("1", runs.limit(2)), ("2", runs.subtract(runs.limit(2))), ("2", runs)):
        ngrams.NgramStats.count(part).add_to(path, name)
    rows = lambda s: (sorted(map(str, s.pairs.collect())), sorted(map(str, s.uni.collect())))
    assert rows(ngrams.NgramStats.load(spark, path)) == rows(ngrams.NgramStats.count(runs))
    with pytest.raises(ValueError):
        ngrams.NgramStats.count(runs).merged(ngrams.NgramStats.count(runs, "dice"))


def test_modal_tag_tie_takes_the_first(spark):
    tok = spark.createDataFrame([(1, 0, "w", "b"), (1, 1, "w", "a"), (2, 0, "w", "a"), (3, 0, "w", "b"), (4, 0, "v", "c")],
                                "sid bigint, idx int, word string, tag string")
    assert {r["word"]: r["tag"] for r in modal_tag(tok).collect()} == {"w": "b", "v": "c"}
    stats = {r["tag"]: (r["count"], r["word_types"], r["ambiguous_words"]) for r in tag_statistics(tok).collect()}
    assert stats == {"a": (2, 1, 1), "b": (2, 1, 1), "c": (1, 1, 0)}


def test_stream_grows_with_new_files(spark, tmp_path):
    folder, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    spark.createDataFrame([("The cat",)], "text string").coalesce(1).write.parquet(folder)
    words = lambda: stream_words(spark, folder, "*.parquet", "text string")
    assert {r["word"]: r["freq"] for r in incremental_word_freq(words(), state, table).collect()} == {"the": 1, "cat": 1}
    spark.createDataFrame([("the dog",)], "text string").coalesce(1).write.mode("append").parquet(folder)
    assert {r["word"]: r["freq"] for r in incremental_word_freq(words(), state, table).collect()} == {"the": 2, "cat": 1, "dog": 1}


def test_stream_table_stays_small_and_survives_a_repeated_batch(spark, tmp_path):
    assert [segments(n) for n in (0, 1, 6, 8)] == [[], [(0, 0)], [(0, 3), (4, 5)], [(0, 7)]]
    folder, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    for i in range(6):
        spark.createDataFrame([(f"all w{i} w{i // 2}",)], "text string").coalesce(1).write.mode("append").parquet(folder)
        got = incremental_word_freq(stream_words(spark, folder, "*.parquet", "text string"), state, table)
        last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
        assert len(list((tmp_path / "table").iterdir())) <= (last + 1).bit_length() + 3
        want = Counter(w for j in range(i + 1) for w in ("all", f"w{j}", f"w{j // 2}"))
        assert {r["word"]: r["freq"] for r in got.collect()} == want
    (tmp_path / "state" / "commits" / str(last)).unlink()  # as if the driver had died after the write
    (tmp_path / "state" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    again = incremental_word_freq(stream_words(spark, folder, "*.parquet", "text string"), state, table)
    assert {r["word"]: r["freq"] for r in again.collect()} == want


def test_character_vectors(spark):
    runs = spark.createDataFrame([("abcabc",)] * 20 + [("x",)], "run string")
    rows = embed.char_vectors(embed.char2vec(runs, size=8, epochs=1)).select("ch", F.size("vector").alias("n")).collect()
    assert {(r["ch"], r["n"]) for r in rows} == {("a", 8), ("b", 8), ("c", 8)}


def test_pairs_of_characters_are_counted_once_by_distance(spark):
    runs = spark.createDataFrame([("abca",), ("bb",), ("x",), ("",), (None,)], "run string")
    got = {(r["ch"], r["by"]): r["n"] for r in embed.pair_counts(runs, window=2).collect()}
    want = Counter()
    for run in ("abca", "bb"):
        for i, a in enumerate(run):
            want[ord(a), -1] += 1
            for j, b in enumerate(run):
                if 0 < abs(i - j) <= 2:
                    want[ord(a), ord(b)] += 3 - abs(i - j)
    assert got == want


def test_vectors_tell_characters_by_their_neighbours(spark):
    """a and b stand in the same places, c and d in others."""
    runs = spark.createDataFrame([("xayxbyxayxby",), ("zcwzdwzcwzdw",)] * 300, "run string")
    v = {r["ch"]: r["vector"] for r in embed.char2vec(runs, size=16, partitions=1).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(v[a], v[b])) / math.hypot(*v[a]) / math.hypot(*v[b])
    assert cos("a", "b") > max(cos("a", "c"), cos("a", "d")) and cos("c", "d") > max(cos("a", "c"), cos("b", "d"))
    assert embed.char2vec(runs.limit(0), size=4).count() == 0
    assert [len(r["vector"]) for r in embed.char2vec(spark.createDataFrame([("aa",)], "run string"), size=4).collect()] == [4]


def test_a_table_with_splits_enough_is_not_shuffled(spark, tmp_path, monkeypatch):
    """The scan of four files keeps four cores busy; one file of one row group is dealt out."""
    plan = lambda path: corpus.read_spread(spark, path, "id", "id")._jdf.queryExecution().toString()
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    spark.range(400).repartition(4).write.parquet(many)
    spark.range(400).coalesce(1).write.parquet(one)
    assert "Exchange" in plan(one)
    monkeypatch.setattr(corpus, "SPREAD_BYTES", 0)
    assert "Exchange" not in plan(many) and "Exchange" in plan(one)
    assert corpus.read_spread(spark, one, "id", "id").count() == 400


def test_a_dictionary_is_learnt_in_one_reading(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, ["ab", "c"], ["n", "m"]) for i in range(10)] + [(11, [], []), (None, ["d"], ["n"])]
    sent = spark.createDataFrame(rows, "sid bigint, words array<string>, tags array<string>")
    model = DictionarySegmenter().fit(sent.mapInArrow(seen, sent.schema))
    assert read.value == len(rows)
    assert {r["word"] for r in model.lex.words.collect()} >= {"ab", "c", "d"}
    assert {(r["word"], r["tag"]) for r in model.tags.collect()} == {("ab", "n"), ("c", "m"), ("d", "n")}


def test_shared_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir", None) in (None, shared_dir(spark))
