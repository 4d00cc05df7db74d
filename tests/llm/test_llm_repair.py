"""Conversation repair against a plain shortest-path search and a row-by-row model."""

import hashlib
import random
import re
import time
import zlib

from pyspark.sql import functions as F

from spanloom.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def slow_edits(rows):
    """(cost, audit) by relaxing (cost, letters) over all states until nothing changes; rows are (initial, fault)."""
    n = len(rows)
    best = {(n, q): (0, "") for q in (0, 3)}
    step = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    for i in range(n, -1, -1):
        for _ in range(6):
            for q in range(4):
                options = [best[(i, q)]] if (i, q) in best else []

                def go(letter, cost, node):
                    if node in best:
                        options.append((cost + best[node][0], letter + best[node][1]))

                for role in "ua":
                    if role in step[q]:
                        go("I", 2, (i, step[q][role]))
                if i < n:
                    initial, fault = rows[i]
                    go("D", 3, (i + 1, q))
                    if fault not in (repair.BLANK, repair.DUPLICATE):
                        t = int(fault == repair.TRUNCATED)
                        if initial in step[q]:
                            go("K", t, (i + 1, step[q][initial]))
                        for role in "ua":
                            if role in step[q]:
                                go("R", 2 + t, (i + 1, step[q][role]))
                if options:
                    best[(i, q)] = min(options)
    return best[(0, 0)]


def slow_repair(rows):
    """The whole contract row by row; rows are (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            rule = zlib.crc32(key.encode()) % 20
            if rule == 1:
                text = ""
            elif rule == 2:
                text = re.sub("[.!?]", "", text)
            elif rule == 4:
                role = "user"
            mine += [(turn, role, text)] * {0: 0, 3: 2}.get(rule, 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, coded = set(), []
        for _, role, text in mine:
            found = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not found else 2 if (role, text) in seen else 0 if found[-1] in ".!?" else 3
            seen.add((role, text))
            coded.append((role[:1], fault))
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = slow_edits(coded)
        fixed, at, last = [], 0, ""
        for letter in audit:
            turn = "assistant" if last == "u" else "user"
            if letter == "I":
                fixed.append((turn, ""))
            else:
                _, role, text = mine[at]
                at += 1
                if letter != "D":
                    fixed.append((role if letter == "K" else turn, text))
            last = fixed[-1][0][0] if fixed else ""
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in fixed))
        faults = [f for _, f in coded]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest)
    return out


def collected(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def test_auction_equals_shortest_paths():
    rng = random.Random(5)
    for trial in range(3000):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "", "x"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 14))]
        codes = bytes(repair.row_code(*r) for r in rows)
        want = slow_edits(rows)
        for span in (1, 3, 16):
            assert repair.cheapest_edits(codes, span) == want, (trial, rows)


def test_auction_work_grows_with_the_rows():
    rng = random.Random(6)
    codes = bytes(rng.randrange(16) for _ in range(200_000))
    start = time.time()
    cost, audit = repair.cheapest_edits(codes)
    assert time.time() - start < 60
    assert len(audit.replace("I", "")) == 200_000 and cost > 0
    assert repair.cheapest_edits(codes[:3000], 16) == repair.cheapest_edits(codes[:3000], 7)


def test_repair_of_random_conversations(spark):
    rng = random.Random(7)
    texts = ["Yes.", "No", "", " \t", "Why? ", "end!\n", "a.b", "é。", "Yes.", None, "..", " "]
    rows = [(c, t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(texts))
            for c in range(300) for t in range(rng.randrange(1, 9)) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collected(repair.damage_and_repair(df)) == slow_repair(rows)


def test_repair_of_odd_rows(spark):
    big = 2**60 + 1
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 4, "assistant", "Ho."), (big, 1, "user", "word. " * 100_000), (big, 2, "assistant", "x"),
            (big, 2, "assistant", "x"), (big, None, "user", "a."), (4, 5, "user", "b."), (4, 5, "assistant", "c."), (4, 5, "assistant", "a?"), (5, None, "", "")]
    rows += [(6, t, "user", "Same.") for t in range(300)] + [(7, 10**12 * t, "assistant", f"{t}.") for t in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("clash")).withColumn("copies", F.lit("clash"))
    got = collected(repair.damage_and_repair(df))
    assert got == slow_repair(rows)
    assert set(got) == {r[0] for r in rows}
    assert repair.damage_and_repair(df.limit(0)).count() == 0
    lost = spark.createDataFrame([(1, 1, "user", "a.")], SCHEMA).withColumn("copies", F.lit(0))
    row = repair.repair_rows(lost, with_rows=True).first()
    assert (row["gaps"], row["cost"], row["audit"], row["turns"], row["repaired_sha256"]) == (0, 0, "", [], hashlib.sha256(b"").hexdigest())


def test_repair_query_on_the_table(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.op11_repair(spark, data)) == slow_repair(rows)
