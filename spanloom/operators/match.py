"""Words of a list found in whole batches of sentences: numpy over Arrow batches, no row per character shuffled.

The list is broadcast as sorted numbers, not as strings: a word is known by its length and a random polynomial hash of 96
bits of its characters (64 place it, 32 more confirm it), so that two texts are taken for one with a chance of some 2^-96 a
comparison. Prefix sums of a batch give the hash of every substring in constant time; a filter of 16 bits a word, one for each
length, lets most go. A list over ``MAX_BYTES`` takes the joins of ``lattice`` instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest list that is broadcast as arrays, in bytes; characters of one step, so that its arrays stay in a core's cache.
MAX_BYTES, PART_CHARS = 1 << 29, 1 << 15
WORD_BYTES = 32
U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
LENGTH_SALT = U(0xA24BAED4963EE407)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^(n-1) modulo 2^64, and their inverses; kept by the process."""
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        run = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]))
        kept = _POWERS[base] = run(U(base)), run(U(pow(base, -1, 1 << 64)))
    return kept[0][:n], kept[1][:n]


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each character."""
    x = codes.astype(U) * U(BASES[0]) + U(0x2545F4914F6CDD1D)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Text:
    """The characters of a batch of strings, end to end; a null counts as empty."""

    def __init__(self, column: pa.Array):
        strings = [x or "" for x in column.to_pylist()]
        self.joined = "".join(strings)
        self.codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4")
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.stops = np.cumsum(self.sizes)
        self.starts = self.stops - self.sizes
        self.n = len(self.codes)
        mixed, self.sums = _mixed(self.codes), []
        for base in BASES:
            power, inverse = _powers(base, self.n)
            self.sums.append((np.concatenate([np.zeros(1, U), np.cumsum(mixed * power, dtype=U)]), inverse))

    def hashes(self, which: int, at: np.ndarray | slice, size: np.ndarray | int, end: np.ndarray | slice) -> np.ndarray:
        total, inverse = self.sums[which]
        return ((total[end] - total[at]) * inverse[at]) ^ (np.asarray(size).astype(U) * LENGTH_SALT)

    def rows(self) -> np.ndarray:
        """The string of each character."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and confirming part of each string; an empty string has a hash of its own."""
        at = np.minimum(self.starts, max(self.n - 1, 0))
        if not self.n:
            return np.zeros(len(self.sizes), U), np.zeros(len(self.sizes), np.uint32)
        key, check = (self.hashes(i, at, self.sizes, at + self.sizes) for i in (0, 1))
        return key, (check >> U(32)).astype(np.uint32)


def _filter(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A bit set of the leading bits of ``keys`` with at least 16 bits a key, small enough for a core's cache, and the shift to its places."""
    bits = max(8, len(keys).bit_length() + 4)
    marked = np.zeros(1 << bits, bool)
    marked[keys >> U(64 - bits)] = True
    return np.packbits(marked, bitorder="little"), 64 - bits


@dataclass
class WordTable:
    """The words by hash: sorted places, confirming parts, lengths that occur, and ``values`` with a row per word; for each length a
    filter of its words."""

    keys: np.ndarray
    checks: np.ndarray
    lengths: np.ndarray
    values: np.ndarray
    first: np.ndarray
    shift: int
    filters: dict[int, tuple[np.ndarray, int]]

    @staticmethod
    def of(keys: np.ndarray, checks: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> "WordTable":
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        bits = max(4, len(keys).bit_length())
        bounds = np.arange(1 << bits, dtype=U) << U(64 - bits)
        first = np.append(np.searchsorted(keys, bounds), len(keys)).astype(np.int32)
        sizes = sizes[order]
        lengths = np.unique(sizes)
        return WordTable(keys, checks[order], lengths, values[order], first, 64 - bits, {n: _filter(keys[sizes == n]) for n in lengths.tolist()})

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 without one."""
        bucket = (keys >> U(self.shift)).astype(np.int64)
        at, end, out = self.first[bucket], self.first[bucket + 1], np.full(len(keys), -1, np.int64)
        live = np.flatnonzero(at < end)
        while live.size:
            k = at[live]
            same = (self.keys[k] == keys[live]) & (self.checks[k] == checks[live])
            out[live[same]] = k[same]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def matches(self, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, row) of every word at every place of every string, shorter ones first."""
        begins, sizes, found = [], [], []
        room = np.repeat(text.stops, text.sizes) - np.arange(text.n)
        longest = text.sizes.max(initial=0)
        for size in self.lengths.tolist():
            if size > longest:
                break
            m = text.n - size + 1
            keys = text.hashes(0, slice(0, m), size, slice(size, None))
            bits, shift = self.filters[size]
            place = keys >> U(shift)
            marked = (bits[place >> U(3)] >> (place & U(7)).astype(np.uint8)) & np.uint8(1)
            at = np.flatnonzero(marked.view(bool) & (room[:m] >= size))
            if at.size:
                checks = (text.hashes(1, at, size, at + size) >> U(32)).astype(np.uint32)
                row = self.find(keys[at], checks)
                hit = row >= 0
                begins.append(at[hit]), sizes.append(np.full(int(hit.sum()), size)), found.append(row[hit])
        whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return whole(begins), whole(sizes), whole(found)


def fits(words: int, width: int = 0) -> bool:
    """Whether so many words with ``width`` values each are broadcast as arrays."""
    return words * (WORD_BYTES + 8 * width) <= MAX_BYTES


def broadcast_words(words: DataFrame, *values: Column):
    """The broadcast table of ``words``, one row per word, with ``values``, columns of numbers; a null is NaN. Empty words match nothing."""
    rows = words.where(F.length("word") > 0).select("word", F.array(*[v.cast("double") for v in values]).cast("array<double>").alias("v"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = Text(batch["word"])
            key, check = text.whole()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.astype(np.int64)), pa.array(text.sizes.astype(np.int32)), batch["v"]],
                                             ["k", "c", "n", "v"])

    table = rows.mapInArrow(hashed, "k bigint, c bigint, n int, v array<double>").toArrow().combine_chunks()
    flat = pc.list_flatten(table["v"]).to_numpy().astype(float).reshape(table.num_rows, len(values))
    made = WordTable.of(table["k"].to_numpy().view(U), table["c"].to_numpy().astype(np.uint32), table["n"].to_numpy(), flat)
    return words.sparkSession.sparkContext.broadcast(made)


def steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``PART_CHARS`` characters, or one string."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // PART_CHARS
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def _schema(df: DataFrame, keep: Sequence[str], *fields: T.StructField) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + list(fields))


def _reach(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all matches, one after the other."""
    size = np.maximum(size, 0)
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


# --- matches by sentence -----------------------------------------------------------------
def span_rows(sent: DataFrame, shared, keep: Sequence[str] = ("sid",), every: bool = False) -> DataFrame:
    """(keep..., spans): the matches of every sentence that has any, or of ``every`` one, as ``array<struct<start,stop>>`` in order."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "s"):
            text = Text(batch["s"])
            begin, size, _ = shared.value.matches(text)
            order = np.lexsort((size, begin))
            begin, size = begin[order], size[order]
            row = np.searchsorted(text.stops, begin, "right")
            start = (begin - text.starts[row]).astype(np.int32)
            counts = np.bincount(row, minlength=batch.num_rows)
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(start + size.astype(np.int32))], ["start", "stop"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            rows = pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.ListArray.from_arrays(offsets, spans)], [*keep, "spans"])
            yield rows if every else rows.filter(pa.array(counts > 0))

    return sent.select(*keep, "s").mapInArrow(found, _schema(sent, keep, T.StructField("spans", T.ArrayType(span))))


def count_rows(sent: DataFrame, shared, by: Sequence[str] = ()) -> DataFrame:
    """(by..., word, occ, hit): matches and those that equal a gold word, counted within each batch; ``by``: one column at most."""
    by = list(by)
    schema = _schema(sent, by, T.StructField("word", T.StringType()), T.StructField("occ", T.LongType()), T.StructField("hit", T.LongType()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "s"):
            text = Text(batch["s"])
            begin, size, word = shared.value.matches(text)
            if not begin.size:
                continue
            gold = np.zeros(text.n, np.int64)
            sizes = pc.utf8_length(pc.list_flatten(batch["words"])).to_numpy(zero_copy_only=False)
            counts = pc.fill_null(pc.list_value_length(batch["words"]), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), counts)
            before = np.cumsum(sizes) - sizes
            lead = np.cumsum(counts) - counts
            at = text.starts[row] + before - (before[np.minimum(lead, max(len(before) - 1, 0))][row] if len(before) else 0)
            inside = at < text.stops[row]
            gold[at[inside]] = sizes[inside]
            group = np.zeros(len(begin), np.int64)
            if by:
                kinds = batch[by[0]].dictionary_encode(null_encoding="encode")
                group = kinds.indices.to_numpy()[np.searchsorted(text.stops, begin, "right")].astype(np.int64)
            key, lead, place, occ = np.unique(group * len(shared.value.keys) + word, return_index=True, return_inverse=True, return_counts=True)
            hit = np.bincount(place, gold[begin] == size).astype(np.int64)
            words = pa.array([text.joined[a:a + n] for a, n in zip(begin[lead].tolist(), size[lead].tolist())], pa.string())
            head = [kinds.dictionary.take(pa.array(group[lead]))] if by else []
            yield pa.RecordBatch.from_arrays([*head, words, pa.array(occ), pa.array(hit)], [*by, "word", "occ", "hit"])

    return sent.select(*by, "s", "words").mapInArrow(counted, schema)


# --- features by position ----------------------------------------------------------------
Columns = Callable[[Text, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch], list[np.ndarray]]


Numbers = Callable[[Text, pa.RecordBatch], list[np.ndarray]]


def matched(shared, columns: Columns) -> Numbers:
    """``columns(text, begin, size, values, batch)`` of the matches of a batch, as what ``character_rows`` takes."""
    def numbers(text: Text, batch: pa.RecordBatch) -> list[np.ndarray]:
        begin, size, word = shared.value.matches(text)
        return columns(text, begin, size, shared.value.values[word], batch)

    return numbers


def position_rows(sent: DataFrame, shared, names: Sequence[str], columns: Columns, keep: Sequence[str] = (), sums: str | None = None,
                  units: float | None = None) -> DataFrame:
    """``character_rows`` of what ``columns`` makes of the matches."""
    return character_rows(sent, names, matched(shared, columns), keep, sums, units)


def character_rows(sent: DataFrame, names: Sequence[str], numbers: Numbers, keep: Sequence[str] = (), sums: str | None = None,
                   units: float | None = None) -> DataFrame:
    """(sid, pos, names): one row per character; ``numbers(text, batch)`` makes the columns of a batch.

    The same numbers summed where they are made, for those who want no more of them: ``sums`` = "place" gives
    (sid, names), per sentence with a text the sums of value times place, counted from 1; "all" gives (names, n:names), a row per
    step with the sums of the values and how many are not 0. With ``units`` values count in whole units of 1 / units.
    """
    kind = T.LongType() if units else T.DoubleType()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "s"):
            text = Text(batch["s"])
            if not text.n:
                continue
            row = text.rows()
            pos = np.arange(text.n) - text.starts[row]
            cols = numbers(text, batch)
            if units:
                cols = [np.floor(c * units + 0.5).astype(np.int64) for c in cols]
            if sums == "all":
                cells = [c.sum(keepdims=True) for c in cols] + [np.array([np.count_nonzero(c)]) for c in cols]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cells)], [*names, *counts])
            elif sums == "place":
                some = np.flatnonzero(text.sizes)
                cells = [np.add.reduceat(c * (pos + 1), text.starts[some]) for c in cols]
                yield pa.RecordBatch.from_arrays([batch["sid"].take(pa.array(some)), *map(pa.array, cells)], ["sid", *names])
            else:
                yield pa.RecordBatch.from_arrays([batch["sid"].take(pa.array(row)), pa.array(pos.astype(np.int32)), *map(pa.array, cols)], ["sid", "pos", *names])

    counts = [f"n:{n}" for n in names]
    fields = [T.StructField(n, kind) for n in names]
    if sums == "all":
        schema = T.StructType(fields + [T.StructField(n, T.LongType()) for n in counts])
    else:
        schema = _schema(sent, ["sid"], *([T.StructField("pos", T.IntegerType())] if sums is None else []), *fields)
    return sent.select("sid", "s", *keep).mapInArrow(made, schema)


class Pairs:
    """Numbers of pairs of characters and of single characters, by code point: characters are numbered, 0 for those that are not
    known, and pairs found in a square table of places, or by search where there are too many characters for one."""

    SQUARE = 1 << 12

    def __init__(self, pairs: pa.Table, single: pa.Table):
        a, b = (Text(pairs[c].combine_chunks()).codes.astype(np.int64) for c in ("a", "b"))
        one = Text(single["ch"].combine_chunks()).codes.astype(np.int64)
        known = np.unique(np.concatenate([a, b, one]))
        self.number = np.zeros(0x110000, np.int32)
        self.number[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        keys = self.number[a].astype(np.int64) * self.width + self.number[b]
        order = np.argsort(keys)
        self.keys = keys[order]
        value = lambda c: np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float))  # noqa: E731 - a null counts as 0
        # the last place is that of pairs without a value
        self.pair_values = [np.append(value(pairs[c])[order], 0.0) for c in pairs.column_names if c not in ("a", "b")]
        self.places = None
        if self.width <= self.SQUARE:
            self.places = np.full(self.width * self.width, len(keys), np.int32)
            self.places[self.keys] = np.arange(len(keys))
        self.code_values = {c: np.zeros(self.width) for c in single.column_names if c != "ch"}
        for c, v in self.code_values.items():
            v[self.number[one]] = value(single[c])

    def of(self, codes: np.ndarray) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
        """The pair values of each character and the next one, and the values of each character; 0 for unknown ones."""
        number = self.number[codes]
        keys = number.astype(np.int64) * self.width + np.append(number[1:], 0)
        if self.places is not None:
            place = self.places[keys]
        else:
            place = np.searchsorted(self.keys, keys)
            near = np.append(self.keys, -1)[place]
            place = np.where(near == keys, place, len(self.keys))
        return [v[place] for v in self.pair_values], {c: v[number] for c, v in self.code_values.items()}


def by_fold(text: Text, begin: np.ndarray, values: np.ndarray, batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Of ``values``, ``width`` a fold, those of the fold of each match's sentence."""
    fold = batch["fold"].to_numpy(zero_copy_only=False)[np.searchsorted(text.stops, begin, "right")].astype(np.int64)
    return np.take_along_axis(values, fold[:, None] * width + np.arange(width), 1)


def marks(name: str, n: int, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1.0 where a word of the length bin begins (B), ends (E) or goes on (I), as in ``B2``, ``I5P``."""
    out = np.zeros(n)
    of = {"2": size <= 2, "3": size == 3, "4": size == 4, "5P": size >= 5}[name[1:]]
    begin, size = begin[of], size[of]
    out[begin if name[0] == "B" else begin + size - 1 if name[0] == "E" else _reach(begin + 1, size - 2)] = 1.0
    return out


def covers(n: int, begin: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1.0 at all places of the chosen matches."""
    out = np.zeros(n)
    out[_reach(begin[of], size[of])] = 1.0
    return out


def best(part: str, n: int, begin: np.ndarray, size: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The largest value of the matches that begin (B), end (E) or lie (I) at each place, 0 without one."""
    out = np.zeros(n)
    if part == "I":
        np.maximum.at(out, _reach(begin, size), np.repeat(value, size))
    else:
        np.maximum.at(out, begin if part == "B" else begin + size - 1, value)
    return out


def mean(n: int, begin: np.ndarray, size: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The mean value of the matches over each place, NaN without one."""
    at = _reach(begin, size)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(at, np.repeat(value, size), n) / np.bincount(at, minlength=n)


# --- maximum matching and tags ------------------------------------------------------------
def _walk(text: Text, step: np.ndarray, back: bool) -> np.ndarray:
    """Whether a word begins at each place, taking ``step`` characters at a time in all strings at once, forward or from the end."""
    begins = np.zeros(text.n, bool)
    at, edge = (text.stops - 1, text.starts) if back else (text.starts, text.stops)
    some = text.sizes > 0
    at, edge = at[some], edge[some]
    while at.size:
        if back:
            at = at - step[at] + 1
        begins[at] = True
        at = at - 1 if back else at + step[at]
        on = at >= edge if back else at < edge
        at, edge = at[on], edge[on]
    return begins


def _segments(text: Text, begins: np.ndarray) -> pa.ListArray:
    """The words that begin at the marked places, as a list per string: the text itself, cut."""
    data = text.joined.encode("utf-8", "surrogatepass")
    wide = 1 + (text.codes >= 0x80) + (text.codes >= 0x800).astype(np.int64) + (text.codes >= 0x10000)
    place = np.cumsum(wide) - wide
    at = np.flatnonzero(begins)
    offsets = np.append(place[at], len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.searchsorted(at, text.stops)).astype(np.int32)), words)


def segment_rows(sent: DataFrame, shared, modes: Sequence[str], fold: bool = False, keep: Sequence[str] = ("sid",)) -> DataFrame:
    """(keep..., one array of words per mode); a sentence without a text gets empty ones. With ``fold`` only words whose value
    of that fold is not 0 count."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "s"):
            text = Text(batch["s"])
            begin, size, word = shared.value.matches(text)
            if fold:
                ok = by_fold(text, begin, shared.value.values[word], batch, 1)[:, 0] != 0
                begin, size = begin[ok], size[ok]
            ahead, behind, known = np.ones(text.n, np.int64), np.ones(text.n, np.int64), np.zeros(text.n, bool)
            for n in np.unique(size).tolist():  # longer ones last
                at = begin[size == n]
                ahead[at], behind[at + n - 1] = n, n
            known[begin[size == 1]] = True
            marked = {"fmm": _walk(text, ahead, False), "bmm": _walk(text, behind, True)}
            row, cost = text.rows(), {}
            for mode, begins in marked.items():
                single = begins & np.append(begins[1:], True)
                cost[mode] = (np.bincount(row[single & ~known], minlength=len(text.sizes)), -np.bincount(row[begins], minlength=len(text.sizes)))
            (fu, fn), (bu, bn) = cost["fmm"], cost["bmm"]
            forward = (fu < bu) | ((fu == bu) & (fn <= bn))
            marked["bidirectional"] = np.where(forward[row], marked["fmm"], marked["bmm"])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *[_segments(text, marked[m]) for m in modes]], [*keep, *modes])

    rows = sent.select(*dict.fromkeys([*keep, "s", *(["fold"] if fold else [])]))
    return rows.mapInArrow(cut, _schema(sent, keep, *[T.StructField(m, T.ArrayType(T.StringType())) for m in modes]))


def tag_rows(rows: DataFrame, words: str, shared, tags: Sequence[str], unseen: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the tags of the array ``words``: the table's value is the place of a tag in ``tags``."""
    names = pa.array([*tags, unseen], pa.string())

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch[words]
            table, row = shared.value, np.zeros(0, np.int64)
            flat = pc.list_flatten(column)
            if len(flat) and len(table.keys):
                row = table.find(*Text(flat).whole())
                place = np.where(row >= 0, table.values[row, 0], len(tags)).astype(np.int64)
            else:
                place = np.full(len(flat), len(tags))
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, names.take(pa.array(place)))], [*batch.schema.names, name])

    return rows.mapInArrow(tagged, _schema(rows, rows.columns, T.StructField(name, T.ArrayType(T.StringType()))))
