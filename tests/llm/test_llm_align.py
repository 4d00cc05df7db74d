"""Cross-tokenizer alignment against counts pair by pair with the tokenizers' libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import align, queries

SCHEMA = "doc_id bigint, text string"
PATTERN = public_tokenizers.PATTERN
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of():
    """Printable stand-ins of bytes, built the other way round: every byte that is no printable Latin-1 character gets the next free one."""
    out, free = {}, 256
    for b in range(256):
        if chr(b).isprintable() and b != 32 and b != 173:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


def slow_align(texts):
    t, sp, back = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_of()
    t.encode_special_tokens = True
    docs = []
    for text in texts:
        groups = []
        if text:
            a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                p = q = 0
                while p < len(a):
                    left, right = [a[p]], [b[q]]
                    p, q = p + 1, q + 1
                    while (la := sum(len(x) for _, x in left)) != (lb := sum(len(x) for _, x in right)):
                        if la < lb:
                            left.append(a[p])
                            p += 1
                        else:
                            right.append(b[q])
                            q += 1
                    groups.append(([i for i, _ in left], [i for i, _ in right]))
        docs.append(groups)
    links = [Counter((x, y) for left, right in g for x in left for y in right) for g in docs]
    count = Counter(pair for c in links for pair in c)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for g, c in zip(docs, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]),
                    sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    total = Counter()
    for c in links:
        total.update(c)
    return out, count, total


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def result(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[n] for n in NAMES)) for r in df.collect())


def odd_texts():
    rng = random.Random(3)
    pool = "abc ABC thé中文字\U0001f600ß!?.,'s 0123\n\t  ▁</s><s><0x41>"
    texts = [None, "", " ", "  two", "a", "a", "x y", "<|endoftext|> <s> </s> <unk> [INST]", "▁", "a▁b", "\x00\x01", "<0x41>", "\r\n\r\n", "é" * 500, "中" * 3000, "ab" * 20_000,
             "word " * 30_000]
    return texts + ["".join(rng.choices(pool, k=rng.randrange(1, 120))) for _ in range(150)] + ["The cat sat, and the dog's hat."] * 20


def test_alignment_equals_counting_pair_by_pair(spark, monkeypatch):
    texts = odd_texts()
    want, count, total = slow_align(texts)
    ids = [2**60 + 1 if i == 5 else None if i == 6 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), SCHEMA).withColumn("a", F.lit("clash")).withColumn("block", F.lit("clash")).repartition(3)
    assert result(align.align(df, BYTES, PATTERN, PIECES)) == sorted((-1 if i is None else i, *w) for i, w in zip(ids, want))
    assert align.align(df.limit(0), BYTES, PATTERN, PIECES).count() == 0
    pairs = {(r["a"], r["b"]): (r["count"], r["links"]) for r in align.pair_table(align.index_documents(df, BYTES, PATTERN, PIECES)[1]).collect()}
    assert pairs == {p: (count[p], total[p]) for p in count}


def test_parts_do_not_change_results(monkeypatch):
    one, two = align.byte_tokens(open(BYTES, encoding="utf-8").read(), PATTERN), align.piece_tokens(open(PIECES, "rb").read())
    for text in ("中" * 400 + "the end of it all. " * 50, "xyzzy" * 300):
        a, b = (np.array(t.encode([text])[0], np.int64) for t in (one, two))
        cuts = align.cut_groups(one.size[a], two.size[b])
        whole = [np.concatenate(x) for x in zip(*align.pair_counts(a, b, *cuts))]
        with monkeypatch.context() as m:
            m.setattr(align, "SMALL", 0)
            assert all(np.array_equal(x, y) for x, y in zip(whole, [np.concatenate(x) for x in zip(*align.pair_counts(a, b, *cuts))]))
        parts = [np.concatenate(x) for x in zip(*align.pair_counts(a, b, *cuts, most=7))]
        for x, y in zip(whole, parts):
            assert np.array_equal(x[np.argsort(whole[0])], y[np.argsort(parts[0])])


def test_planes_and_containers():
    rng = np.random.default_rng(1)
    index, want = align.Index(), {}
    for place in range(9000):
        pairs = np.array([5 << 32 | 7, 6 << 32 | 1] if place % 3 else [5 << 32 | 7])
        links = rng.integers(1, 40, len(pairs))
        index.add(place, pairs, links)
        for p, n in zip(pairs, links):
            want[(p >> 32, p & 0xFFFFFFFF, place)] = n
    rows = index.postings(3)
    got = {}
    for r in rows.itertuples():
        for place in align.members(r.bitmap).tolist():
            got[(r.a, r.b, place)] = got.get((r.a, r.b, place), 0) + (1 << r.plane)
    assert got == want and index.held == 0
    assert {(r.a, r.b): (r.docs, r.links) for r in rows[rows.docs > 0].itertuples()} == {
        (5, 7): (9000, sum(n for k, n in want.items() if k[0] == 5)), (6, 1): (6000, sum(n for k, n in want.items() if k[0] == 6))}
    assert any(len(b) == 8192 for b in rows.bitmap) and any(len(b) < 8192 for b in rows.bitmap)


def test_alignment_query_on_the_table(spark):
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want, _, _ = slow_align([r["text"] for r in rows])
    assert result(queries.op13_align(spark, data)) == sorted((r["doc_id"], *w) for r, w in zip(rows, want))
