"""Chat formatting as a prefix tree: shared initial turns are emitted once, depth first.

A turn is formatted as ``<turn>### role: text</turn>`` and a line end; "\\\\", "<" and "#" in texts (and ":" in
roles) are escaped, so no text can look like a control string, and unescaping gives it back. A node of the
tree is a turn under its ancestors, named by a chained 128-bit hash. Nodes without a fork between them make a
chain. A chain's key is, for every fork above it, the depth and the name of the branch taken: in the lexicographic order of keys a
subtree is contiguous and a chain stands before what hangs below it, so this is a depth-first order. (A fork needs another conversation as long as
the path to it, so all keys together take no more than some 40 bytes per turn of the input.) A range-partitioned sort of chains, without texts,
and one running sum over parts' lengths then give every chain, and with it every node, its place in the sequence: no tree is ever
gathered, however many conversations begin alike. Tokens are code points. Token j of a node has position id
pos_start + j, and attends to the ancestors' intervals of the sequence and to its own node up to itself.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import exact_id
from spanloom.plans.scale import fits_broadcast, keyed_join
from spanloom.session import as_table

OPEN, MIDDLE, CLOSE = "<turn>### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
#: Code points of the sequence that are found together when it is read by intervals.
BLOCK = 1024

_ESCAPES = {"\\": "\\\\", "<": "\\l", "#": "\\h", ":": "\\c"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\:]|\\.)*)" + re.escape(MIDDLE) + r"((?:[^\\<]|\\.)*)" + re.escape(CLOSE), re.S)


def escape(text: str, also: str = "") -> str:
    return re.sub(f"[\\\\<#{also}]", lambda m: _ESCAPES[m.group()], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m.group(1)], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start, end of the loss mask in it); the mask is empty but for assistants."""
    head = OPEN + escape(role, ":") + MIDDLE
    body = escape(text)
    start = len(head)
    return head + body + CLOSE, start, start + (len(body) if role == ASSISTANT else 0)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; raises if anything but whole turns is found."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


NODE = ("conv_id string, last binary, parent binary, node binary, depth int, pos_start bigint, segment string, "
        "loss_start int, loss_end int, leaf boolean")
TURN = ("node binary, head binary, at bigint, stop bigint, key binary, ups array<struct<head:binary,used:bigint>>")


def _nodes(batches):
    for batch in batches:
        rows = []
        for conv, turns in zip(batch["conv_id"], batch["turns"]):
            node, pos, own = None, 0, []
            for i, t in enumerate(turns):
                segment, start, end = format_turn(t["role"] or "", t["text"] or "")
                parent, node = node, hashlib.md5((node or b"") + segment.encode()).digest()
                own.append((parent, node, i, pos, segment, start, end, i == len(turns) - 1))
                pos += len(segment)
            rows += [(conv, node, *x) for x in own]
        yield pd.DataFrame(rows, columns=["conv_id", "last", "parent", "node", "depth", "pos_start", "segment", "loss_start", "loss_end", "leaf"])


def _chains(batches):
    """Chain and place in it of each turn of a path; a chain's first turn also bears its key and how much of the chains above belongs to the path."""
    for batch in batches:
        rows = []
        for turns in batch["turns"]:
            key, ups, head, begin = b"", [], None, 0
            for t in turns:
                first = t["depth"] == 0 or t["forked"]
                if first:
                    if head is not None:
                        ups.append((head, t["pos_start"] - begin))
                    head, begin = t["node"], t["pos_start"]
                    key += t["depth"].to_bytes(4, "big") + head
                rows.append((t["node"], head, t["pos_start"] - begin, t["stop"] - begin, key if first else None, list(ups) if first else None))
        yield pd.DataFrame(rows, columns=["node", "head", "at", "stop", "key", "ups"])


def _place(batches):
    """Local start of each chain within its part of the sorted chains."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = at + batch["size"].cumsum()
        yield batch.drop(columns="key").assign(part=part, local_start=ends - batch["size"], local_end=ends)
        at = int(ends.iloc[-1]) if len(ends) else at


def _touching(batches):
    """Intervals in order, touching ones as one."""
    for batch in batches:
        rows = []
        for head, spans in zip(batch["head"], batch["spans"]):
            out: list[tuple[int, int]] = []
            for s in spans:
                if out and out[-1][1] == s["start"]:
                    out[-1] = (out[-1][0], s["stop"])
                else:
                    out.append((s["start"], s["stop"]))
            rows.append((head, out))
        yield pd.DataFrame(rows, columns=["head", "above"])


def _look_up(big: DataFrame, small: DataFrame, on: str, how: str) -> DataFrame:
    return keyed_join(big, small, [on], how, small_fits=fits_broadcast(small), spread=["node"])


def chains_of(made: DataFrame) -> DataFrame:
    """Every node's chain and place in it, once per distinct conversation through it."""
    forks = as_table(made.where("parent is not null").groupBy("parent").agg((F.min("node") != F.max("node")).alias("forked")).where("forked"), "chat-forks")
    # one row per turn of each distinct conversation, never one per pair of turns, and without texts
    turn = made.groupBy("last", "depth").agg(*[F.first(c).alias(c) for c in ("parent", "node", "pos_start")],
                                             F.first(F.col("pos_start") + F.length("segment")).alias("stop"))
    marked = _look_up(turn, forks, "parent", "left")
    paths = marked.groupBy("last").agg(F.sort_array(F.collect_list(F.struct(
        "depth", "node", "pos_start", "stop", F.coalesce("forked", F.lit(False)).alias("forked")))).alias("turns"))
    return as_table(paths.select("turns").mapInPandas(_chains, TURN), "chat-chains")


def place_chains(turns: DataFrame) -> DataFrame:
    """(head, seq): where each chain starts in the depth-first sequence."""
    chain = turns.groupBy("head").agg(F.max("stop").alias("size"), F.max("key").alias("key"))
    ordered = chain.repartitionByRange("key").sortWithinPartitions("key")
    placed = as_table(ordered.mapInPandas(_place, "head binary, size bigint, part int, local_start bigint, local_end bigint"), "chat-placed")
    # one row per part of the sort: bounded by the number of partitions
    before = placed.groupBy("part").agg(F.max("local_end").alias("total")).withColumn(
        "base", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return as_table(placed.join(F.broadcast(before.select("part", "base")), "part").select(
        "head", (F.col("base") + F.col("local_start")).alias("seq")), "chat-sequence")


def conversation_tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(emission, leaves) of conversations given by turn (conv_id, turn, role, text).

    emission, one row per node: seq_start, seq_end, pos_start, depth, segment, loss_start, loss_end, node,
    intervals (array of (start, stop) that cover the ancestors, root first; touching ones are one). leaves: conv_id, node of its last turn.
    Turns are ordered by turn, then role and text, nulls first; null role and text count as empty; each row of a
    null conv_id is a conversation of its own, as nothing says which belong together; repeated rows are repeated turns; further columns are ignored; an
    empty table gives empty results. A conversation is one list in one task; turns that no other conversation branches off from share one interval.
    """
    turns = rows.select(rows["conv_id"].cast("bigint").cast("string").alias("conv_id"), rows["turn"].cast("bigint").alias("turn"),
                        rows["role"].alias("role"), rows["text"].alias("text"))
    known = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    alone = turns.where("conv_id is null").select("conv_id", F.array(F.struct("turn", "role", "text")).alias("turns"))
    made = as_table(exact_id(known.unionAll(alone).mapInPandas(_nodes, NODE), "conv_id"), "chat-turns")
    on_path = chains_of(made)
    placed = place_chains(on_path)
    ups = on_path.where("key is not null").groupBy("head").agg(F.first("ups").alias("ups")).select(
        F.col("head").alias("node"), F.explode("ups").alias("up")).select("node", "up.head", "up.used")
    above = _look_up(ups, placed, "head", "inner").groupBy(F.col("node").alias("head")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("seq").alias("start"), (F.col("seq") + F.col("used")).alias("stop")))).alias("spans"))
    above = above.mapInPandas(_touching, "head binary, above array<struct<start:bigint,stop:bigint>>")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    heads = as_table(placed.join(above, "head", "left").select("head", "seq", F.coalesce("above", none).alias("above")), "chat-heads")
    place = _look_up(on_path.groupBy("node").agg(F.first("head").alias("head"), F.first("at").alias("at")), heads, "head", "inner")
    # the part of the own chain before the node goes on from the last interval where they touch
    seq, last = F.col("seq"), F.try_element_at("above", F.lit(-1))
    span = lambda start: F.array(F.struct(start.alias("start"), (seq + F.col("at")).alias("stop")))
    intervals = F.when(F.col("at") == 0, F.col("above")).when(
        last["stop"] == seq, F.concat(F.slice("above", F.lit(1), F.size("above") - 1), span(last["start"]))).otherwise(F.concat("above", span(seq)))
    place = place.select("node", (seq + F.col("at")).alias("seq_start"), intervals.alias("intervals"))
    node = made.groupBy("node").agg(*[F.first(c).alias(c) for c in ("depth", "pos_start", "segment", "loss_start", "loss_end")])
    emission = node.join(place, "node").select(
        "node", "depth", "pos_start", "segment", "loss_start", "loss_end", "seq_start",
        (F.col("seq_start") + F.length("segment")).alias("seq_end"), "intervals")
    return as_table(emission, "chat-emission"), made.where("leaf").select("conv_id", "node")


def _read(batches):
    for batch in batches:
        rows = []
        for node, parts in zip(batch["node"], batch["parts"]):
            formatted, loss, pos = "", [], 0
            pieces = []
            for p in parts:
                if p["pos_start"] != pos:
                    raise ValueError("position ids do not go on")
                pos += len(p["segment"])
                pieces.append(p["segment"])
                loss.append(unescape(p["segment"][p["loss_start"]:p["loss_end"]]))
            formatted, masked = "".join(pieces), "".join(loss)
            turns = parse(formatted)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((node, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(masked),
                         hashlib.sha256(masked.encode()).hexdigest(), len(formatted)))
        yield pd.DataFrame(rows, columns=["node", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(emission: DataFrame, leaves: DataFrame) -> DataFrame:
    """Digests per conversation, read from the emitted sequence through the attention intervals.

    Each distinct conversation is read once, however many conv_ids share it.
    """
    last = emission.join(leaves.select("node").distinct(), "node", "left_semi")
    own = F.array(F.struct(F.col("seq_start").alias("start"), F.col("seq_end").alias("stop")))
    span = last.select("node", F.explode(F.concat("intervals", own)).alias("span")).select("node", "span.start", "span.stop")
    # an interval is looked up in the blocks of the sequence that it touches
    seen = span.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("stop") - 1) / BLOCK))))
    piece = emission.select(F.floor(F.col("seq_start") / BLOCK).alias("block"), "seq_start", "pos_start", "segment", "loss_start", "loss_end")
    parts = seen.join(piece, "block").where("seq_start >= start and seq_start < stop").groupBy("node").agg(F.sort_array(F.collect_list(
        F.struct("seq_start", "pos_start", "segment", "loss_start", "loss_end"))).alias("parts"))
    digests = parts.mapInPandas(_read, "node binary, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return leaves.join(digests, "node").drop("node")
