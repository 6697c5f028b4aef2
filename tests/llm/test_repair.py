"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.llm import repair
from framelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDY = re.compile(r"[^\x20\x09-\x0D]")


def least(rows):
    """(cost, audit, repaired lines) by trying every edit: rows are (role, text, fault)."""

    names, table = {"u": "user", "a": "assistant"}, {}
    for i in range(len(rows), -1, -1):
        for inserted, seen in itertools.product((3, 2, 1, 0), ("", "s", "u", "a")):  # the last role seen before row i
            ways, due = [], "a" if seen == "u" else "u"
            if i == len(rows) and seen in ("", "a"):
                ways.append((0, "", ()))
            if inserted < 3:
                c, s, t = table[i, due, inserted + 1]
                ways.append((5 + c, "I" + s, (names[due] + ":", *t)))
            if i < len(rows):
                role, text, fault = rows[i]
                c, s, t = table[i + 1, seen, 0]
                ways.append((2 + c, "D" + s, t))
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault == "truncated" else 0
                    if role[:1] == due or role[:1] == "s" and seen == "":
                        c, s, t = table[i + 1, role[:1], 0]
                        ways.append((more + c, "K" + s, (f"{role}:{text}", *t)))
                    c, s, t = table[i + 1, due, 0]
                    ways.append((1 + more + c, "R" + s, (f"{names[due]}:{text}", *t)))
            table[i, seen, inserted] = min(ways, default=(10**9, "", ()))
    return table[0, "", 0]


def expected(rows):
    """The report by brute force for (conv_id, turn, role, text) with distinct turns or equal rows."""
    whole = {}
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        own = whole.setdefault(conv, [])
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv, own in whole.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        seen, judged = set(), []
        for _, role, text in own:
            found = WORDY.findall(text)
            fault = "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        count = lambda k: sum(f == k for _, _, f in judged)  # noqa: E731, B023
        cost, audit, lines = least(tuple(judged)) if judged else (0, "", ())
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in NAMES) for r in rows}


def test_query_against_brute_force(spark):
    given = pd.read_parquet(f"{SF}/conversations.parquet")
    rows = list(given[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    assert found(QUERIES["op11_conversation_repair"](spark, SF)) == expected(rows)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_odd_rows(spark):
    r = random.Random(5)
    texts = ["Yes.", "No!", "well", " ", "", None, "a? ", "done.\n", "é…", "x" * 200_000 + "."]
    rows = []
    for conv in [*range(60), None]:
        for turn in [None, *sorted(r.sample(range(-3, 30), r.randrange(0, 12)))]:
            if turn is not None or r.random() < 0.3:
                rows.append((conv, turn, r.choice(["system", "user", "assistant", "tool", "", None, "u"]), r.choice(texts)))
    rows += [(500, 1, "user", "Same.")] * 3 + [(501, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.lit("clash")).withColumn("chunk", F.lit(1)).repartition(5)
    got, want = found(repair.repair_report(df)), expected(rows)
    assert got == want
    assert repair.repair_report(df.filter("false")).count() == 0


def test_one_long_conversation(spark, monkeypatch):
    """Chunks of eight rows, spread over tasks: as the string walked through at once."""
    monkeypatch.setattr(repair, "CHUNK_BITS", 3)
    r = random.Random(6)
    rows = [(7, k, r.choice(["user", "assistant", "assistant", "tool", "system"]), r.choice(["Oh.", "um"]) + (f" {k}." if r.random() < 0.8 else "")) for k in range(400)]
    rows += [(8, k, "user", f"{k}") for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(repair.repair_report(df)) == expected(rows)


def test_block_tables_against_all_edits():
    r = random.Random(7)
    table = repair.tables()
    kinds = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(400):
        symbols = [r.randrange(9) for _ in range(r.randrange(1, 14))]
        fault = lambda x: "blank" if x == 8 else "truncated" if x > 3 else None
        rows = tuple((kinds["suao"[x % 4]], "t", fault(x)) for x in symbols)
        text = "".join(map(str, symbols))
        edits, end = table.trace(text, table.end, 0)
        edits[-1] += table.tail(end)
        costs = table.costs([text])[0][0]
        cost, audit, _ = least(rows)
        assert min(c + t for c, t in zip(costs, table.vectors[table.end])) == cost
        assert "".join(edits).translate({ord("u"): None, ord("a"): None}) == audit


def test_repaired_rows_are_legal(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There"), (1, 2, "tool", "So."), (2, 0, "assistant", "Yes.")]
    out = repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "at", "step").collect()
    for conv in (1, 2):
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in out if x.conv_id == conv and x.edit != "D"))
    assert [(x.edit, x.role, x.text) for x in out if x.conv_id == 1] == [("K", "user", "Hi."), ("D", "user", "There"), ("R", "assistant", "So.")]


@pytest.mark.parametrize("symbols", ["", "0", "8888", "12" * 5000])
def test_costs_of_plain_strings(symbols):
    table = repair.tables()
    got = min(c + t for c, t in zip(table.costs([symbols])[0][0], table.vectors[table.end]))
    assert got == {"": 0, "0": 2, "8888": 8}.get(symbols, 0)
