"""Conversation structure repair: cheapest edits that make the turns alternate, by an auction for shortest paths.

A conversation of n rows is a lattice of 4 (n + 1) nodes: how many rows are read, and what the repaired turns end
with (nothing, a system turn, a user turn, an assistant turn). Arcs are edits with whole-number costs. Every node
has a price; a path grows from its origin: if the price of its last node is below the best (arc cost + price of
the head), the price is raised to that and the path contracts by one node, else it extends along that arc. A path
that reaches a settled node is a shortest one and settles its own nodes. Origins are the nodes of every ``SPAN``-th
layer, last layer first, so that paths stay short and the work grows with the rows; prices of layers not yet seen
start at the lowest settled price, which no arc contradicts. The edits are then traced forward along tight arcs
(price = cost + price of the head) in order of their letters; a head that is not settled yet is an origin first.

Rows meet twice: as about 50 bytes each (role, digest, faults) to find the edits, and with their texts to hash the
repaired conversation. Both times Spark sorts them and they are streamed; a task keeps some bytes a row of one
conversation, never its texts.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

USER, ASSISTANT = "user", "assistant"
#: White space of the contract: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
RULES = 20
#: Layers between two layers of origins (changes the work, not the result).
SPAN = 16

EMPTY, SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: State after a turn of a role initial; a missing entry is not allowed.
NEXT = [{"s": SYSTEM, "u": AFTER_USER}, {"u": AFTER_USER}, {"a": AFTER_ASSISTANT}, {"u": AFTER_USER}]
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAULTS = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNCATED}
LETTERS = "DIKR"


def _arcs(initial: str, fault: int, last: bool = False) -> list[list[tuple[str, int, int]]]:
    """Per state the arcs (letter, offset of the head's number, cost) in order of letters."""
    out = []
    for state, following in enumerate(NEXT):
        turn = following.get("u", following.get("a"))
        arcs = []
        if not last:
            arcs.append(("D", 4, 3))
        arcs.append(("I", turn - state, 2))
        if not last and fault not in (BLANK, DUPLICATE):
            extra = int(fault == TRUNCATED)
            if initial in following:
                arcs.append(("K", 4 + following[initial] - state, extra))
            arcs.append(("R", 4 + turn - state, 2 + extra))
        out.append(arcs)
    return out


INITIALS = "sua"
#: Arcs by row code: 4 * (place of the initial in "sua", 3 for others) + fault; the last entry has no row to read.
ARCS = [_arcs(initial, fault) for initial in ["s", "u", "a", ""] for fault in range(4)] + [_arcs("", FINE, last=True)]


def row_code(initial: str, fault: int) -> int:
    return 4 * (INITIALS.index(initial) if initial in INITIALS and initial else 3) + fault


class Auction:
    """Prices over the lattice of one conversation, given by its row codes."""

    def __init__(self, codes: bytes, span: int = SPAN):
        self.codes = codes + bytes([len(ARCS) - 1])
        self.price = array("q", bytes(32 * len(self.codes)))
        self.settled = bytearray(4 * len(self.codes))
        end = 4 * len(codes)
        self.settled[end + EMPTY] = self.settled[end + AFTER_ASSISTANT] = 1
        top = end
        for node in range(end, end + 4):
            self.settle(node)
        for layer in range((len(codes) - 1) // span * span, -1, -span):
            low = min(self.price[top:top + 4])
            for node in range(4 * layer, top):
                self.price[node] = low
            top = 4 * layer
            for node in range(top, top + 4):
                self.settle(node)

    def settle(self, origin: int) -> None:
        """Auction from ``origin``: its price becomes its distance to the end."""
        codes, price, settled, path = self.codes, self.price, self.settled, [origin]
        while True:
            node = path[-1]
            if settled[node]:
                for each in path:
                    settled[each] = 1
                return
            best, head = None, node
            for _, offset, cost in ARCS[codes[node >> 2]][node & 3]:
                through = cost + price[node + offset]
                if best is None or through < best:
                    best, head = through, node + offset
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)

    def trace(self) -> tuple[int, str]:
        """(cost, letters) of the cheapest edits, the ASCII-least letters of all such."""
        codes, price, end, node, letters = self.codes, self.price, 4 * len(self.codes) - 4, 0, []
        # an insertion always costs, so the walk ends at the first end node without cost to go
        while node < end or price[node]:
            for letter, offset, cost in ARCS[codes[node >> 2]][node & 3]:
                head = node + offset
                if price[node] == cost + price[head]:
                    self.settle(head)
                    if price[node] == cost + price[head]:
                        break
            else:
                raise RuntimeError("no tight arc at a settled node")
            letters.append(letter)
            node = head
        return price[0], "".join(letters)


def cheapest_edits(codes: bytes, span: int = SPAN) -> tuple[int, str]:
    return Auction(codes, span).trace()


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after the planted damage; copies is 0, 1 or 2.

    Null roles and texts become one space, and so do null numbers in the hashed key ``conv_id:turn``.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(rows["conv_id"].cast("string"), space), F.lit(":"), F.coalesce(rows["turn"].cast("string"), space))
    rule = F.crc32(key) % RULES
    text, role = F.coalesce(rows["text"], space), F.coalesce(rows["role"], space)
    return rows.select(
        rows["conv_id"].cast("bigint").alias("conv_id"), rows["turn"].cast("bigint").alias("turn"),
        F.when(rule == 4, F.lit(USER)).otherwise(role).alias("role"),
        F.when(rule == 1, F.lit("")).when(rule == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(rule == 0, 0).when(rule == 3, 2).otherwise(1).alias("copies"))


STATS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
#: Numbers travel through Python as text, as pandas would turn integers beside nulls into floats.
CODES = ", ".join(f"{name} string" for name in STATS)


class _Conversation:
    """What is kept of a conversation while its rows stream by."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.before, self.illegal = conv_id, bytearray(), None, 0
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, initial, fault, repeated, copies):
        for i in range(copies):
            now = fault if fault == BLANK else DUPLICATE if repeated or i else fault
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            self.codes.append(row_code(initial, now))
        if copies and turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.turns += 1
            self.high = turn

    def row(self):
        count = [sum(self.codes.count(4 * i + f) for i in range(4)) for f in FAULTS.values()]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, *map(str, (gaps, *count, self.illegal, *cheapest_edits(bytes(self.codes)))))


def _ints(column) -> list[int | None]:
    return [None if x is None else int(x) for x in column]


def _solve(batches):
    """Sorted narrow rows of whole conversations to one row of counts and edits each."""
    now = None
    for batch in batches:
        out = []
        for conv, turn, initial, fault, repeated, copies in zip(
                batch["conv_id"], _ints(batch["turn"]), batch["initial"], batch["fault"], batch["repeated"], batch["copies"]):
            if now is None or conv != now.conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(conv)
            now.add(turn, initial, fault, repeated, copies)
        if out:
            yield pd.DataFrame(out, columns=STATS)
    if now is not None:
        yield pd.DataFrame([now.row()], columns=STATS)


class _Repaired:
    """Running hash of a repaired conversation: rows are fed in order, the letters say what becomes of them."""

    def __init__(self, result, keep_rows: bool):
        self.result, self.letters, self.at, self.state, self.hash = result, result[-1], 0, EMPTY, hashlib.sha256()
        self.rows = [] if keep_rows else None
        self.empty = True

    def write(self, role: str, text: str) -> None:
        if not self.empty:
            self.hash.update(b"\n")
        self.empty = False
        self.state = NEXT[self.state][role[0]]
        self.hash.update(f"{role}:{text}".encode())
        if self.rows is not None:
            self.rows.append((role, text))

    def turn(self) -> str:
        return ASSISTANT if self.state == AFTER_USER else USER

    def inserts(self) -> None:
        while self.letters[self.at:self.at + 1] == "I":
            self.at += 1
            self.write(self.turn(), "")

    def read(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            self.write(role if letter == "K" else self.turn(), text)

    def row(self):
        self.inserts()
        if self.at != len(self.letters) or self.state not in (EMPTY, AFTER_ASSISTANT):
            raise ValueError("the edits do not fit the rows")
        return (*self.result, self.hash.hexdigest(), *([] if self.rows is None else [self.rows]))


def _rewrite(with_rows: bool, names: list[str]):
    def run(batches):
        now = None
        for batch in batches:
            out = []
            for i, (first, role, text, copies) in enumerate(zip(batch["first"], batch["role"], batch["text"], batch["copies"])):
                if first:
                    if now is not None:
                        out.append(now.row())
                    now = _Repaired(tuple(batch[c].iat[i] for c in STATS), with_rows)
                else:
                    for _ in range(int(copies)):
                        now.read(role, text)
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([now.row()], columns=names)
    return run


def repair_rows(rows: DataFrame, with_rows: bool = False) -> DataFrame:
    """Repair conversations given by rows (conv_id, turn, role, text, copies); ``copies`` repeats a row next to it.

    Returns per conv_id: gaps (turn numbers missing between the first and the last), blank, duplicate and truncated
    (rows by their first fault), illegal (neighbours whose role initials are not su, ua or au), cost, audit (the
    letters of the edits: Delete, Insert, Keep, Rerole), repaired_sha256, and with ``with_rows`` the repaired turns
    as an array of (role, text), which holds a conversation in memory.

    Rows are taken by turn, nulls first, those of one turn by role and then by the MD5 of their text. Null roles
    and texts count as one space. Rows of a null conv_id form one conversation. Repeated rows are duplicates from
    the second on. A conversation without rows (copies 0) has zeros, no edits and the hash of the empty text.
    Further columns are ignored, an empty table gives an empty one, texts and conversations may have any length;
    gaps beyond BIGINT are null.
    """
    space = F.lit(" ")
    text, role = F.coalesce(rows["text"], space), F.coalesce(rows["role"], space)
    plain = rows.select(rows["conv_id"].cast("bigint").cast("string").alias("conv_id"), rows["turn"].cast("bigint").cast("string").alias("turn"),
                        role.alias("role"), text.alias("text"), rows["copies"].cast("int").alias("copies"), F.md5(text).alias("digest"))
    order = [F.col("turn").cast("bigint"), "role", "digest"]

    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (F.when(F.trim(trimmed, F.lit(WHITE)) == "", BLANK)
             .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE))
    narrow = plain.select("conv_id", "turn", "role", "copies", "digest", fault.alias("fault")).repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").cast("bigint")).rowsBetween(Window.unboundedPreceding, -1)
    coded = narrow.withColumn("repeated", F.coalesce(F.max("copies").over(seen), F.lit(0)) > 0)
    solved = (coded.select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "fault", "repeated", "copies")
              .sortWithinPartitions("conv_id", *order, "repeated").mapInPandas(_solve, CODES))

    empty = [F.lit(None).cast("string").alias(name) for name in STATS[1:]]
    body = ["turn", "role", "digest", "text"]
    bodies = plain.where("copies > 0").select("conv_id", F.lit(False).alias("first"), *body, "copies", *empty)
    heads = solved.select("conv_id", F.lit(True).alias("first"), *[F.lit(None).cast("string").alias(name) for name in body],
                          F.lit(0).alias("copies"), *STATS[1:])
    whole = bodies.unionAll(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.col("first").desc(), *order)
    schema = CODES + ", repaired_sha256 string" + (", turns array<struct<role:string,text:string>>" if with_rows else "")
    names = [*STATS, "repaired_sha256", *(["turns"] if with_rows else [])]
    done = whole.mapInPandas(_rewrite(with_rows, names), schema)
    return done.select(*[F.col(name).try_cast("bigint").alias(name) for name in STATS[:-1]], "audit", "repaired_sha256", *names[9:])


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """The planted damage, then its repair: one row per conv_id of ``rows``, see damaged() and repair_rows()."""
    return repair_rows(damaged(rows))
