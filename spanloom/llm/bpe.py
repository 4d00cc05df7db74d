"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are split by the tokenizer's pattern. The distinct pieces of a batch that are not yet known are
bucketed by byte length and laid out as padded matrices of token ids. In every round each row merges its
leftmost pair of minimum rank; ranks come from an open-addressing hash table over pairs of ids; rows that
are done leave the matrix, the others are compacted to the left. Pieces over ``LONG`` bytes, for which rounds over a
whole row would cost the square of their length, make the same merges in the same order from a heap.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from spanloom.llm.common import exact_id

NONE = np.int32(2**31 - 1)
LONG = 256
CELLS = 1 << 19
#: Pieces a worker remembers at most; beyond that it starts anew (memory bound, results do not depend on it).
REMEMBER = 400_000

OUTPUT = "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: per line a token in base 64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _hash(keys: np.ndarray, mask: int) -> np.ndarray:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)).astype(np.int64) & mask


class Pairs:
    """Hash table from pairs of ids to the id of their concatenation, with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, value = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), value.append(rank)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        value = np.array(value, np.int32)
        self.mask = (1 << max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int32)
        todo, slot = np.arange(len(keys)), _hash(keys, self.mask)
        while len(todo):
            free = self.keys[slot] < 0
            spot, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[spot >= 0]
            self.keys[slot[first]], self.values[slot[first]] = keys[todo[first]], value[todo[first]]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            # those that met a taken slot go on; those that lost a race meet it taken next time
            step = (self.keys[slot] >= 0)[rest]
            todo, slot = todo[rest], (slot[rest] + step) & self.mask

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for no merge; negative ids are padding."""
        shape, a, b = a.shape, a.ravel().astype(np.int64), b.ravel().astype(np.int64)
        out = np.full(len(a), NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a[todo] << 32) | b[todo]
        slot = _hash(keys, self.mask)
        while len(todo):
            found = self.keys[slot]
            hit = found == keys
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found >= 0)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class ByteBPE:
    """Encoder and decoder for one rank table and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.pairs = Pairs(ranks)
        self.start = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_of = {rank: str(rank) for rank in ranks.values()}
        self.known: dict[str, list[int]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, an empty piece gives none."""
        out: list[list[int]] = [[] for _ in pieces]
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) > LONG:
                out[i] = self._long(p)
            elif p:
                by_width.setdefault(-(-len(p) // 4) * 4, []).append(i)
        for width, rows in by_width.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                self._matrix(pieces, rows[k:k + step], width, out)
        return out

    def _matrix(self, pieces, rows, width, out) -> None:
        flat = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        size = np.array([len(pieces[i]) for i in rows])
        ids = np.where(np.arange(width) < size[:, None], self.start[flat], np.int32(-1))
        rank = self.pairs.ranks_of(ids[:, :-1], ids[:, 1:])
        at = np.array(rows)
        while len(at):
            pos = rank.argmin(1)
            line = np.arange(len(at))
            best = rank[line, pos]
            done = best == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[at[r]] = ids[r, :size[r]].tolist()
                keep = ~done
                ids, rank, size, at, pos, best = ids[keep], rank[keep], size[keep], at[keep], pos[keep], best[keep]
                if not len(at):
                    return
                wide = int(size.max())
                ids, rank, line = ids[:, :wide], rank[:, :wide - 1], np.arange(len(at))
            ids[line, pos] = best
            cols = np.arange(ids.shape[1])
            ids = np.take_along_axis(ids, np.minimum(cols + (cols > pos[:, None]), ids.shape[1] - 1), 1)
            size = size - 1
            ids[line, size] = -1
            cols = cols[:-1]
            rank = np.take_along_axis(rank, np.minimum(cols + (cols > pos[:, None]), len(cols) - 1), 1)
            rank[line, size - 1] = NONE
            here = np.minimum(pos + 1, ids.shape[1] - 1)
            after = np.where(pos + 1 < ids.shape[1], ids[line, here], -1)
            fits = pos < rank.shape[1]
            rank[line[fits], pos[fits]] = self.pairs.ranks_of(ids[line, pos], after)[fits]
            left = pos > 0
            rank[line[left], pos[left] - 1] = self.pairs.ranks_of(ids[line, pos - 1], ids[line, pos])[left]

    def _long(self, piece: bytes) -> list[int]:
        """The leftmost pair of minimum rank is always on top of a heap; merged places are unlinked, stale entries passed over."""
        ids = self.start[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.ranks_of(ids[:-1], ids[1:])
        at = np.flatnonzero(rank != NONE)
        heap = list(zip(rank[at].tolist(), at.tolist(), ids[at].tolist(), ids[at + 1].tolist()))
        heapify(heap)
        ids = ids.tolist()
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))

        def push(a: int, b: int) -> None:
            merged = self.ranks.get(self.bytes_of[ids[a]] + self.bytes_of[ids[b]])
            if merged is not None:
                heappush(heap, (merged, a, ids[a], ids[b]))

        while heap:
            best, a, left, right = heappop(heap)
            b = after[a]
            if ids[a] != left or b == len(ids) or ids[b] != right:
                continue
            ids[a], ids[b], after[a] = best, -1, after[b]
            if after[a] < len(ids):
                before[after[a]] = a
                push(a, after[a])
            if before[a] >= 0:
                push(before[a], a)
        return [i for i in ids if i >= 0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as the encoder of ordinary text of the tokenizer's library gives them."""
        split = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBER:
            self.known = {}
        new = list(set(chain.from_iterable(split)).difference(self.known))
        self.known.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        return [list(chain.from_iterable(map(self.known.__getitem__, s))) for s in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _chunks(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters together; a longer text is alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns id, n_tokens, SHA-256 of the ids (decimal, comma-joined) and of the decoded bytes, and with
    ``with_ids`` the ids as an array. Null texts count as empty: no tokens. Null ids, repeated rows and further
    columns do no harm (one row out per row in, only the two columns are read); texts of any length are
    encoded whole. An empty table gives an empty one. A narrow map: nothing is shuffled; the rank table
    (a fixed file of about 1 MB) is broadcast.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast((read_ranks(ranks_path), pattern))

    def run(batches):
        bpe = ByteBPE(*table.value)
        for batch in batches:
            rows = []
            for part in _chunks(batch["text"].fillna("").tolist()):
                for ids in bpe.encode(part):
                    rows.append((len(ids), hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest(),
                                 hashlib.sha256(bpe.decode(ids)).hexdigest(), *([ids] if with_ids else [])))
            names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    source = docs.select(docs[id_col].cast("bigint").cast("string").alias("doc_id"), docs[text_col].alias("text"))
    return exact_id(source.mapInPandas(run, OUTPUT + (", ids array<int>" if with_ids else "")))
