"""Cross-tokenizer alignment with inverted pair bitmaps.

A text is encoded by two tokenizers, and the byte offsets where tokens of both end cut it into groups. Every token of
the first is linked with every token of the second in the same group. Documents are numbered within blocks of 65,536,
and an inverted index holds for each pair of token ids and block the documents that link it, as compressed bitmaps:
16-bit numbers, or 8 kB of bits from 4,096 documents on. How often a document links a pair is kept in planes: plane k
holds the documents whose number has bit k set. The planes' union is the pair's document bitmap, whose population adds
up to the pair's document count; populations times 2^k add up to its links. The postings then return the scores: each
bitmap adds its pair's count to its documents, block by block. A pair's occurrences are never shuffled one by one.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bpe import _chunks
from spanloom.llm.common import exact_id
from spanloom.plans.scale import fits_broadcast
from spanloom.session import as_table

BLOCK = 1 << 16
#: Documents from which a container is a bitmap instead of a list.
DENSE = 4096
#: Entries (pair, document) expanded or held at once, about (memory only, results do not depend on it).
ENTRIES = 1 << 21
#: Characters handed to a tokenizer in one call; a longer text is alone.
CALL = 500_000
#: Links of a group up to which its occurrences are multiplied out; beyond, its distinct ids.
SMALL = 64

DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
INDEXED = ("block bigint, place int, doc_id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "a int, b int, plane int, bitmap binary, docs bigint, links bigint")


def byte_level() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokens:
    """What is needed of a tokenizer: ids of texts, and per id its bytes, their number, and its decimal with a separator."""

    def __init__(self, encode, pieces: list[bytes], last: str):
        self.encode, self.pieces = encode, pieces
        self.size = np.array([len(p) for p in pieces], np.int64)
        # the second half of the table is for the last token of a group
        self.decimal = np.array([f"{i}," for i in range(len(pieces))] + [f"{i}{last}" for i in range(len(pieces))], object)


@lru_cache(1)  # a worker reads the vocabularies once
def byte_tokens(text: str, pattern: str) -> Tokens:
    """A byte-level BPE from the JSON format of the tokenizers library, ``pattern`` being that of its byte-level splitter;
    texts get a space in front.

    Merges must stand in the order of their results' ids. Then ids are ranks, and the encoder of ordinary text
    that works on ranks gives the same ids, several times as fast.
    """
    file = json.loads(text)
    model, splitter, back = file["model"], file["pre_tokenizer"], byte_level()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    if file["normalizer"] or splitter["type"] != "ByteLevel" or splitter["add_prefix_space"] or ids != sorted(ids):
        raise ValueError("not a plain byte-level BPE")
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(map(back.__getitem__, name)): i for name, i in model["vocab"].items() if name not in special}
    pieces = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Tokens(lambda texts: [coder.encode_ordinary(" " + t) for t in texts], pieces, "|")


@lru_cache(1)
def piece_tokens(model: bytes) -> Tokens:
    """A sentencepiece model, which puts the space in front itself."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    pieces = [bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
    return Tokens(lambda texts: sp.encode(texts, num_threads=1), pieces, ";")


def cut_groups(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, as numbers of tokens of each side; both sides spell the same bytes."""
    _, at_a, at_b = np.intersect1d(np.cumsum(size_a), np.cumsum(size_b), assume_unique=True, return_indices=True)
    return at_a + 1, at_b + 1


def _in_groups(ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often) of the distinct ids of each group, ordered by group."""
    group = np.searchsorted(cuts, np.arange(len(ids)), "right")
    key, times = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times


def pair_counts(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, most: int = ENTRIES):
    """Yields (pairs, links): distinct pairs a << 32 | b of one document in no more than about ``most`` at a time, each pair once.

    Distinct ids of a long group are multiplied with their numbers, so that long repeats cost no more than their ids.
    """
    n_a, n_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
    each = n_a * n_b
    if each.max() <= SMALL and each.sum() <= most:
        w = np.repeat(n_b, n_a)  # tokens of b that each token of a is linked with
        j = np.arange(each.sum()) + np.repeat(np.repeat(cuts_b - n_b, n_a) - (np.cumsum(w) - w), w)
        yield np.unique(np.repeat(a, w) << 32 | b[j], return_counts=True)
        return
    group_a, id_a, times_a = _in_groups(a, cuts_a)
    group_b, id_b, times_b = _in_groups(b, cuts_b)
    start_b = np.searchsorted(group_b, np.arange(len(cuts_b) + 1))
    width = np.diff(start_b)[group_a]
    order = np.argsort(id_a, kind="stable")
    # parts end where an id of the first side ends, so that each pair is complete in its part
    total = np.cumsum(width[order])
    ends = np.flatnonzero(np.r_[np.diff(id_a[order]) > 0, True]) + 1
    part = total[ends - 1] // most
    cut = ends[np.r_[np.diff(part) > 0, True]]
    for start, stop in zip(np.r_[0, cut[:-1]], cut):
        own = order[start:stop]
        w = width[own]
        i = np.repeat(own, w)
        j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + start_b[group_a[i]]
        yield _summed(id_a[i] << 32 | id_b[j], times_a[i] * times_b[j])


class Index:
    """Postings of the documents of a task, handed on as bitmaps whenever enough are gathered."""

    def __init__(self):
        self.pairs, self.places, self.links, self.held = [], [], [], 0

    def add(self, place: int, pairs: np.ndarray, links: np.ndarray) -> None:
        self.pairs.append(pairs)
        self.places.append(np.full(len(pairs), place, np.uint16))
        self.links.append(links)
        self.held += len(pairs)

    def postings(self, block: int) -> pd.DataFrame:
        """One row per pair and plane; the first plane of a pair carries the population of all its planes' union."""
        pair, place, links = np.concatenate(self.pairs), np.concatenate(self.places), np.concatenate(self.links)
        self.__init__()
        order = np.argsort(pair, kind="stable")
        pair, place, links = pair[order], place[order], links[order]
        first = np.flatnonzero(np.r_[True, np.diff(pair) > 0])
        number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(pair)]))
        docs, sums = np.bincount(number), np.add.reduceat(links, first)
        rows, planes = [], []
        for k in range(int(links.max()).bit_length()):
            has = np.flatnonzero(links >> k & 1)
            rows.append(has)
            planes.append(np.full(len(has), k))
        rows, planes = np.concatenate(rows), np.concatenate(planes)
        by = np.lexsort((rows, planes, number[rows]))
        rows, planes = rows[by], planes[by]
        start = np.flatnonzero(np.r_[True, (np.diff(number[rows]) > 0) | (np.diff(planes) != 0)])
        stop = np.r_[start[1:], len(rows)]
        flat = place[rows].astype("<u2")
        raw = flat.tobytes()
        bitmaps = [raw[2 * s:2 * e] if e - s < DENSE else bits(flat[s:e]) for s, e in zip(start.tolist(), stop.tolist())]
        own = number[rows[start]]
        head = np.r_[True, np.diff(own) > 0]
        return pd.DataFrame({"block": block, "a": (pair[first] >> 32)[own], "b": (pair[first] & 0xFFFFFFFF)[own], "plane": planes[start],
                             "bitmap": bitmaps, "docs": np.where(head, docs[own], 0), "links": np.where(head, sums[own], 0)})


def bits(places: np.ndarray) -> bytes:
    return np.packbits(np.bincount(places, minlength=BLOCK).astype(bool)).tobytes()


def members(bitmap: bytes) -> np.ndarray:
    """Places in a container: a list, or as many bits as a block has places."""
    if len(bitmap) == BLOCK // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))
    return np.frombuffer(bitmap, "<u2")


def _summed(pairs: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(pairs, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(pairs[by]) > 0])
    return pairs[by][first], np.add.reduceat(links[by], first)


class Aligner:
    """Both tokenizers, and what a text gives with them."""

    def __init__(self, one: Tokens, two: Tokens):
        self.one, self.two = one, two

    def document(self, text: str, a: list[int], b: list[int]):
        """Numbers of tokens of each side, groups and links; hash of the groups; (pairs, links) in parts."""
        want = b" " + text.encode()
        if not text or b"".join(map(self.one.pieces.__getitem__, a)) != want or b"".join(map(self.two.pieces.__getitem__, b)) != want:
            return (0, 0, 0, 0), "", ()
        left, right = np.array(a, np.int64), np.array(b, np.int64)
        cuts_a, cuts_b = cut_groups(self.one.size[left], self.two.size[right])
        n_a, n_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        # tokens of both sides in the order of groups, each with its separator
        written = np.empty(len(a) + len(b), object)
        in_a, in_b = left.copy(), right.copy()
        in_a[cuts_a - 1] += len(self.one.pieces)
        in_b[cuts_b - 1] += len(self.two.pieces)
        written[np.arange(len(a)) + np.repeat(cuts_b - n_b, n_a)] = self.one.decimal[in_a]
        written[np.arange(len(b)) + np.repeat(cuts_a, n_b)] = self.two.decimal[in_b]
        groups = "".join(written.tolist())[:-1]
        return ((len(a), len(b), len(cuts_a), int(n_a @ n_b)), hashlib.sha256(groups.encode()).hexdigest(),
                pair_counts(left, right, cuts_a, cuts_b))

    def documents(self, texts: list[str]):
        return map(self.document, texts, self.one.encode(texts), self.two.encode(texts))


def _aligner(shared):
    def run(batches):
        vocabulary, pattern, model = shared.value
        aligner = Aligner(byte_tokens(vocabulary, pattern), piece_tokens(model))
        task, count, index = TaskContext.get().partitionId(), 0, Index()
        for batch in batches:
            ids = iter(batch["doc_id"])
            for texts in _chunks(batch["text"].fillna("").tolist(), CALL):
                done = []
                for numbers, digest, parts in aligner.documents(texts):
                    block, place = task << 32 | count // BLOCK, count % BLOCK
                    done.append((block, place, next(ids), *numbers, digest))
                    for pairs, links in parts:
                        index.add(place, pairs, links)
                        if index.held >= ENTRIES:
                            yield _rows(index.postings(block))
                    count += 1
                    if count % BLOCK == 0 and index.held:
                        yield _rows(index.postings(block))
                yield _rows(pd.DataFrame(done, columns=["block", "place", *DOCUMENT]))
        if index.held:
            yield _rows(index.postings(task << 32 | (count - 1) // BLOCK))
    return run


def _rows(part: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in INDEXED.split(", ")]
    for name in names:
        if name not in part:
            part[name] = None if name in ("doc_id", "groups_sha256", "bitmap") else -1 if name in ("place", "plane") else 0
    return part[names]


def _score(batches):
    """Rows (block, plane, bitmap, count, best) sorted by block to (block, place, n_best, count_sum) of its documents."""
    now, sums, best = None, None, None

    def out():
        at = np.flatnonzero(sums)
        return pd.DataFrame({"block": now, "place": at, "n_best": best[at], "count_sum": sums[at]})

    for batch in batches:
        blocks = batch["block"].to_numpy()
        starts = np.flatnonzero(np.r_[True, np.diff(blocks) != 0])
        for s, e in zip(starts, np.r_[starts[1:], len(blocks)]):
            if blocks[s] != now:
                if now is not None:
                    yield out()
                now, sums, best = blocks[s], np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            links = 1 << batch["plane"].to_numpy()[s:e].astype(np.int64)
            places = [members(x) for x in batch["bitmap"].iloc[s:e]]
            size = [len(p) for p in places]
            at = np.concatenate(places)
            np.add.at(sums, at, np.repeat(links * batch["count"].to_numpy()[s:e], size))
            np.add.at(best, at, np.repeat(links * batch["best"].to_numpy()[s:e], size))
    if now is not None:
        yield out()


def index_documents(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, postings), both written once.

    documents: block, place, doc_id, n_a, n_b, n_groups, n_links, groups_sha256. postings: a, b, block, plane, bitmap,
    docs, links; the first plane of a pair in a posting carries its document and link counts, the others zero. One narrow
    pass; the vocabulary files (fixed, some MB) are broadcast.
    """
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern, g.read()))
    source = docs.select(docs[id_col].cast("bigint").cast("string").alias("doc_id"), docs[text_col].alias("text"))
    made = as_table(exact_id(source.mapInPandas(_aligner(shared), INDEXED)), "align-index")
    documents = made.where("place >= 0").select("block", "place", *DOCUMENT)
    return documents, made.where("place < 0").select("a", "b", "block", "plane", "bitmap", "docs", "links")


def pair_table(postings: DataFrame) -> DataFrame:
    """(a, b, count, links, best): documents and links of each pair in the corpus; best if no pair of its a has a larger count."""
    counts = as_table(postings.where("docs > 0").groupBy("a", "b").agg(F.sum("docs").alias("count"), F.sum("links").alias("links")), "align-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return as_table(counts.join(top, "a").select("a", "b", "count", "links", (F.col("count") == F.col("top")).cast("int").alias("best")), "align-pairs")


def align(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair has the highest document count of all pairs of its a, count_sum adds up the
    counts over links. Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no
    tokens: zeros and an empty hash. Null ids are kept; repeated rows are documents of their own, in the counts too;
    further columns are ignored; texts of any length are used whole; an empty table gives an empty one.
    """
    documents, postings = index_documents(docs, byte_path, pattern, piece_path, id_col, text_col)
    pairs = pair_table(postings).drop("links")
    scored = (postings.select("a", "b", "block", "plane", "bitmap").join(F.broadcast(pairs) if fits_broadcast(pairs) else pairs, ["a", "b"])
              .select("block", "plane", "bitmap", "count", "best").repartition("block").sortWithinPartitions("block")
              .mapInPandas(_score, "block bigint, place int, n_best bigint, count_sum bigint"))
    zero = F.lit(0).cast("bigint")
    return documents.join(scored, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256")
