"""Tokenising, SimHash, quality, personal data: against libraries, brute force and held-out labels."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import bpe, pii, quality, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DATA = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
big = 2**60 + 1


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS).withColumn("fp", F.lit("clash")).withColumn("score", F.lit("clash"))


ODD = [(big, None), (None, ""), (3, " \n\t"), (4, "a"), (4, "a"), (5, "x1@y.zz " * 30_000), (6, "word\n" * 40_000), (7, "q" * 50_000)]


@pytest.fixture(scope="module")
def tokenizer():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE(bpe.read_ranks(RANKS), PATTERN)


def test_bpe_equals_the_library(coder, tokenizer, monkeypatch):
    rng = random.Random(4)
    pool = "abcdefgh aeiou ththeéßè中文\U0001f600!?.*$ \n\t0123  ́"
    texts = ["".join(rng.choices(pool, k=rng.randrange(0, 80))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdeth", k=n)) for n in (300, 1000, 5000)] + ["ab" * 900, "a" * 3001, "!" * 700, "abab" * 300 + "b"]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}" for c in [*range(0, 0x3400), *range(0xA000, 0xB000), *range(0x1F000, 0x1F800)]]
    want = [tokenizer.encode_ordinary(t) for t in texts]
    assert coder.encode(texts) == want
    assert all(coder.decode(ids) == t.encode() for ids, t in zip(want, texts))
    pieces = [p.encode() for t in texts[:2000] for p in coder.pieces(t)]
    short = coder.encode_pieces(pieces)
    monkeypatch.setattr(bpe, "LONG", 1)
    assert coder.encode_pieces(pieces) == short


def test_long_pieces_take_near_linear_time(coder, tokenizer):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000))
    start = time.time()
    ids = coder.encode([text])[0]
    assert time.time() - start < 30
    assert ids == tokenizer.encode_ordinary(text)


def test_bpe_query_on_odd_rows(spark, tokenizer):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(frame(spark, ODD), RANKS, PATTERN).collect())
    want = []
    for i, t in ODD:
        ids = tokenizer.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(frame(spark, ODD).limit(0), RANKS, PATTERN).count() == 0


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i:i + 3]).encode(), 42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fp):
    parent = {v: v for v in fp.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 2:
                parent[root(a)] = root(b)
    groups = {}
    for d, v in fp.items():
        groups.setdefault(root(v), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


@pytest.mark.parametrize("limit", [simhash.SUBTREE, 4])
def test_simhash_equals_brute_force(spark, limit):
    rng = random.Random(2)
    vocab = ["ÉTE", "the", "Of", "and", "ßx", "thon", "a"] + [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        words = rng.choices(vocab, k=rng.randrange(0, 400))
        for _ in range(rng.choice([1, 1, 3, 6])):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "\n", " \t"]).join(copy))
    docs = frame(spark, [(i * 7 % 1009, t) for i, t in enumerate([*texts, None, "", " ", " ", "one two"])])
    fp = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs.collect()}
    comp = slow_components(fp)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs, limit=limit).collect()}
    assert got == {d: (f"{fp[d]:016x}", comp[d]) for d in fp}


@pytest.mark.parametrize("limit", [simhash.SUBTREE, 8])
def test_trie_join_finds_every_link(spark, limit):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for s in seeds for _ in range(20)} | {0, 2**64 - 1, 1, 2**63}
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    linked = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(rows, limit).collect()}
    assert all(bin(a ^ b).count("1") <= 64 for a, b in linked)
    want = slow_components(dict(enumerate(sorted(values))))
    from spanloom.llm.common import components
    label = {r["node"]: r["label"] for r in components(simhash.links(rows, limit), "t").collect()}
    groups = {}
    for i, v in enumerate(sorted(values)):
        s = v - (1 << 64) if v >> 63 else v
        groups.setdefault(label.get(s, s), set()).add(i)
    assert sorted(map(min, groups.values())) == sorted(set(want.values()))
    assert {i: min(g) for g in groups.values() for i in g} == want


def test_simhash_on_odd_rows(spark):
    rows = simhash.simhash_groups(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {big, None, 3} and {r["component_id"] for r in zero} == {3}
    assert simhash.simhash_groups(frame(spark, ODD).limit(0)).count() == 0


def test_components_of_a_path(spark):
    from spanloom.llm.common import components
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1000), (5, 5), (None, 4)], "a bigint, b bigint")
    label = {r["node"]: r["label"] for r in components(edges, "t").collect()}
    assert len(label) == n + 2 and len({label[i] for i in range(n)}) == 1 and label[1000] == label[1001] != label[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for d, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.97
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if r["predicted"]}


def test_all_labelled_documents_are_learnt_from_with_all_lines(spark, monkeypatch):
    rows = [(i, f"line {i} of a text\n" * (500 if i == 3 else 1 + i % 3)) for i in range(5200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (docs.doc_id % 2).cast("int").alias("quality"))
    wanted = {r["doc_id"] for r in docs.where(~quality.held_out(docs.doc_id)).collect()}
    found = []
    monkeypatch.setattr(quality, "fit", found.extend)
    quality.train(docs, labels)
    assert len(found) == len(wanted) > 4000 and sorted(len(d[0]) for d in found) == sorted(500 if i == 3 else 1 + i % 3 for i in wanted)


def test_learning_from_blocks_equals_learning_on_the_driver(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["Some plain words here.", "$$ ## !!", "buy buy buy", "A longer line of plain words, as text has."]) if i % 2 else "## $$ buy buy"
                          for _ in range(rng.randint(1, 12)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 10 < 2, 1 - docs.doc_id % 2).otherwise(docs.doc_id % 2).cast("int").alias("quality"))
    few = quality.train(docs, labels)
    monkeypatch.setattr(quality, "LOCAL_LINES", 0)
    monkeypatch.setattr(quality, "BLOCK_LINES", 500)
    for most in (0, 1 << 20):  # in partitions, on the driver
        monkeypatch.setattr(quality, "DRIVER_LINES", most)
        many = quality.train(docs, labels)
        for name in ("mean", "scale", "w", "trans", "slope", "offset"):
            assert np.allclose(getattr(few, name), getattr(many, name), rtol=1e-5, atol=1e-7), name


def test_long_documents_are_learnt_from_in_one_stretch():
    for lines, size in ((0, 4), (1, 4), (4, 4), (5, 4), (1000, 400)):
        for draw in range(30):
            at = np.arange(lines)[quality.stretch(lines, size, draw)]
            assert len(at) == min(lines, size) and (np.diff(at) == 1).all()
    assert {quality.stretch(1000, 400, d).start for d in range(5000)} == set(range(601))


def test_quality_on_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, None), (6, None, 0), (None, 1, 1), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, ODD)
    for lab in (labels, labels.limit(0)):
        rows = quality.score(docs, quality.train(docs, lab)).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    doc = np.repeat([0, 1, 2], [4, 1, 3])
    unary, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, log_z = quality.forward_backward(unary, trans, doc)
    total = np.zeros((2, 2))
    for k in range(3):
        own = np.flatnonzero(doc == k)
        z, g = 0.0, np.zeros(len(own))
        for code in range(2 ** len(own)):
            y = [code >> i & 1 for i in range(len(own))]
            w = np.exp(sum(unary[own[i]] * y[i] for i in range(len(own))) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += w
            g += w * np.array(y)
        assert np.allclose(good[own], g / z) and np.isclose(log_z[k], np.log(z))
        for code in range(2 ** len(own)):
            y = [code >> i & 1 for i in range(len(own))]
            w = np.exp(sum(unary[own[i]] * y[i] for i in range(len(own))) + sum(trans[a, b] for a, b in zip(y, y[1:]))) / z
            for a, b in zip(y, y[1:]):
                total[a, b] += w
    assert np.allclose(pairs, total)


# The contract's patterns as they stand, run by the regular expression engine.
KIND_PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, pattern in enumerate(KIND_PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and max(map(int, m.group().split("."))) > 255 or k == 3 and not 10 <= len(digits) <= 15:
                continue
            if k == 2:
                odd = [int(d) for d in digits[-1::-2]] + [sum(map(int, str(2 * int(d)))) for d in digits[-2::-2]]
                if not 14 <= len(digits) <= 19 or sum(odd) % 10:
                    continue
            out.append((m.start(), k, m.end()))
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab.@-+ 12345()0é\n_%", k=rng.randrange(60))) for _ in range(20_000)]
    texts += ["".join(rng.choices(["4111 1111 1111 1111", "4111-1111-1111-1111", " ", "1.2.3.4", "+1 (555) 123-4567", "a@b.cc", "@", ".", "0012.3.4.5", "300.1.1.1"], k=5)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_network_finds_what_it_was_taught(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").select("text").collect()]
    model = pii.train(docs)
    base = [pii.base_spans(t) for t in texts]
    want = {(i, *s) for i, b in enumerate(base) for s in b}
    alone = {(i, *s) for i, b in enumerate(pii.added_spans(texts, [[] for _ in texts], model)) for s in b}
    assert len(want & alone) >= 0.8 * len(want) and len(want & alone) >= 0.8 * len(alone)
    got = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    for i, b in enumerate(base):
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in plain_spans(texts[i])).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert len(spans) == len(b) + r["n_added"] and {f"{k}:{s}:{e}" for s, e, k in b} <= set(spans)
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(b)


def test_pii_on_odd_rows(spark):
    docs = frame(spark, ODD)
    model = pii.train(docs, sample=40)
    rows = pii.find(docs, model).collect()
    assert len(rows) == len(ODD) and sorted(r["n_email"] for r in rows)[-1] == 30_000
    assert {r["doc_id"] for r in rows} == {big, None, 3, 4, 5, 6, 7}
    assert pii.find(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_network_gradient():
    model = pii.Tagger.new(1)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    rng = np.random.default_rng(2)
    ids = rng.integers(1, pii.VOCAB, (9, 3))
    ids[6:, 1] = 0
    gold = np.zeros((9, 3), int)
    gold[2, 0], gold[3, 0] = 1, 2
    _, grad = model.gradient(ids, gold)
    for name in ("uf", "wb", "bf", "out", "trans", "emb"):
        flat = model.p[name].reshape(-1)
        for at in rng.integers(0, flat.size, 3):
            old, e = flat[at], 1e-3
            flat[at] = old + e
            up = model.gradient(ids, gold)[0]
            flat[at] = old - e
            down = model.gradient(ids, gold)[0]
            flat[at] = old
            assert abs((up - down) / (2 * e) - grad[name].reshape(-1)[at]) < 2e-3, name
