"""Conversation repair against every possible edit of small conversations, and its defined cases."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from graphloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
ORDER = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    """(blank, duplicate, truncated, cost, audit, repaired) by trying all edits, with up to two insertions anywhere."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0d]", "", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    choices = [[("D", None, 4)] if f in ("b", "d") else [("D", None, 4), ("K", r[2], 3 * (f == "t")), ("R", "user", 3 + 3 * (f == "t")), ("R", "assistant", 3 + 3 * (f == "t"))] for r, f in zip(rows, faults)]
    fillings = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in product(*choices):
        for gaps in product(fillings, repeat=len(rows) + 1):
            cost = sum(e[2] for e in edits) + 3 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            audit, made = "", []
            for k, gap in enumerate(gaps):
                audit += "I" * len(gap)
                made += [(r, "") for r in gap]
                if k < len(rows):
                    audit += edits[k][0]
                    if edits[k][0] != "D":
                        made.append((edits[k][1], rows[k][3]))
            if all(r for r, _ in made) and ORDER.fullmatch("".join(r[0] for r, _ in made)):
                new = (cost, audit, "\n".join(f"{r}:{t}" for r, t in made))
                best = min(best, new) if best else new
    cost, audit, made = best
    turns = sorted(r[1] for r in rows if r[1] is not None)
    initials = [r[2][:1] for r in rows]
    return {
        "gaps": turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(made.encode()).hexdigest(),
    }


def made_up(n, seed):
    rng = random.Random(seed)
    for conv in range(n):
        for k in range(rng.randrange(5)):
            yield conv, rng.choice([k, k, k, k + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Hi.", "Yes!\n", "no end", " \t", "", "Hi.", "Why? ", None])


def test_every_edit_of_small_conversations(spark):
    rows = list(made_up(80, 5))
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {r.conv_id: r for r in repair.digests(repair.repair(df)).collect()}
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv, got in plain.items():
        assert got.asDict() == {"conv_id": conv} | brute([r for r in filled if r[0] == conv])
    assert set(plain) == {r[0] for r in rows}
    hurt = {r.conv_id: r for r in repair.digests(repair.repair(repair.damage(df), "lost")).collect()}
    for conv, got in hurt.items():
        assert got.asDict() == {"conv_id": conv} | brute([r for r in damaged(rows) if r[0] == conv])
    assert set(hurt) == set(plain)  # also those that lost all rows


def test_spilled_conversations_and_batches(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"c{t}.", ""])) for t in range(3000)] + [(8, 0, "user", "x."), (9, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    whole = sorted(map(tuple, repair.repair(df).collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert sorted(map(tuple, repair.repair(df, held_rows=64).collect()), key=str) == whole
        assert sorted(map(tuple, repair.repair(df, held_chars=50).collect()), key=str) == whole
        digests = {r.conv_id: r for r in repair.digests(repair.repair(df, held_rows=64)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert digests[8].audit == "KI" and digests[9].audit == "D"
    kept = [r for r in whole if r[0] == 7 and r[1] != "D"]
    assert sum(r[7] for r in whole if r[0] == 7) == digests[7].cost and len(digests[7].audit) == sum(r[0] == 7 for r in whole) and kept


def test_a_hot_conversation_is_one_linear_stream(spark):
    df = spark.range(60_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    out = repair.digests(repair.repair(df, held_rows=10_000)).collect()
    assert len(out) == 1 and out[0].audit == "K" * 60_000 and out[0].cost == 0
    assert len(repair.STEPS.steps) < 5000


def test_defined_cases(spark):
    assert repair.digests(repair.repair(spark.createDataFrame([], SCHEMA))).count() == 0
    extra = spark.createDataFrame([(None, None, None, None, "x", True), (1, None, "user", "Hi.", "y", None), (1, 2, "assistant", "x" * 300_000 + ".", "z", False), (1, 2, "assistant", "x" * 300_000 + ".", "z", False)], SCHEMA + ", edit string, gone boolean")
    out = {r.conv_id: r for r in repair.digests(repair.repair(extra)).collect()}
    assert (out[None].audit, out[None].cost, out[None].blank, out[None].gaps) == ("D", 4, 1, 0)
    assert (out[1].audit, out[1].duplicate, out[1].illegal, out[1].gaps) == ("KKD", 1, 1, 0)
    lost = repair.digests(repair.repair(extra.withColumn("lost", F.lit(True)), "lost")).collect()
    assert all(r.audit == "" and r.cost == 0 and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in lost) and len(lost) == 2


def test_the_query_is_the_same_as_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = list(made_up(200, 9)) + [(None, 0, "user", "A?"), (None, 1, "assistant", "b")]
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = db.execute(repair.REPAIR_SQL)
    names = [c[0] for c in got.description]
    out = repair.digests(repair.repair(repair.damage(spark.createDataFrame(rows, SCHEMA)), "lost"))
    assert sorted(map(str, (tuple(r[n] for n in names) for r in out.collect()))) == sorted(map(str, got.fetchall()))
