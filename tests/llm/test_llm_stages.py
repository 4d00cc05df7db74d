"""The pipeline's deduplication stages: repeated rows, null ids and planted near copies."""

import random
import re

import corpus_pipeline
from spanloom.llm import near, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"w{i}" for i in range(3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).repartition(5)


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


#: Repeated rows, one id with several texts, null ids alone and as copies.
REPEATED = [(1, "a b"), (1, "a b"), (2, "p q r"), (2, "s t u"), (3, "p q r"), (None, "a  b"), (None, "x y z"), (None, "x y z"), (None, "own text"), (4, None), (5, "")]
ONE_EACH = sorted([(1, "a b"), (2, "p q r"), (2, "s t u"), (None, "x y z"), (None, "own text"), (4, None)], key=repr)


def test_exact_stage_keeps_one_of_each(spark):
    docs = frame(spark, REPEATED)
    out = corpus_pipeline.exact_dedup(spark, docs, "")
    assert out.columns == docs.columns and left(out) == ONE_EACH
    assert corpus_pipeline.exact_dedup(spark, docs.limit(0), "").count() == 0


def test_near_stage_keeps_one_of_each(spark):
    docs = frame(spark, REPEATED)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and left(out) == ONE_EACH
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def plain_similarity(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (re.findall(r"\S+", t.lower()) for t in (a, b)))
    return len(a & b) / len(a | b)


def test_near_stage_drops_what_is_alike_and_nothing_else(spark):
    rng = random.Random(6)
    rows, alike = [], {}
    for i in range(120):
        words = rng.choices(WORDS, k=rng.randrange(120, 400))
        copy = list(words)
        for k in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.choice([0.005, 0.01, 0.02, 0.06])))):
            copy[k] = rng.choice(WORDS)
        a, b = " ".join(words), " ".join(copy).upper()
        rows += [(2 * i, a), (2 * i + 1 if i % 10 else None, b)]
        alike[i] = plain_similarity(a, b)
        assert abs(near.similarity(near.shingles(a), near.shingles(b)) - alike[i]) < 1e-12
    assert 60 < sum(s >= 0.8 for s in alike.values()) < 120
    out = {r["text"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert all(rows[2 * i][1] in out for i in alike)
    assert [i for i, s in alike.items() if (rows[2 * i + 1][1] in out) != (s < 0.8)] == []


def test_near_stage_links_by_fingerprints_too(spark):
    """Texts that differ in a word order's case or in one word of very many, but not in their fingerprint by more than two bits."""
    rng = random.Random(9)
    words = rng.choices(WORDS, k=40)
    texts = [" ".join(words * 30), " ".join((words * 31)[:-1])]  # shingles alike by set, counted differently
    texts += [" ".join(rng.choices(WORDS, k=300)) for _ in range(4)]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(None, texts[2])]
    bits = lambda a, b: (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(frame(spark, rows)).where("doc_id IS NOT NULL").collect()}
    kept = left(simhash.drop_near(frame(spark, rows)))
    assert kept == sorted([(i, t) for i, t in rows if i is not None and groups[i] == i], key=repr)
    assert (2 in [i for i, _ in kept]) == (bits(texts[0], texts[1]) > 2)
    assert left(corpus_pipeline.near_dedup(spark, frame(spark, rows), "")) == left(near.drop_near(simhash.drop_near(frame(spark, rows))))
    assert simhash.drop_near(frame(spark, rows).limit(0)).count() == 0
