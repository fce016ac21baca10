"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from quillweave.llm import turn_repair
from quillweave.llm.queries import op11_turn_repair

BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired rows) by best-first search: rows are (role, text, fault)."""
    heap = [(0, "", 0, 0, ())]
    seen = {}
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        if seen.get((i, state), (cost, audit)) < (cost, audit):
            continue
        seen[i, state] = cost, audit
        steps = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
        after = {"s": 1, "u": 2, "a": 3}
        full = {"u": "user", "a": "assistant"}
        for x in steps:
            if x in full and len(audit) < 3 * len(rows) + 4:
                heapq.heappush(heap, (cost + 3, audit + "I", i, after[x], (*out, (full[x], ""))))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        more = 3 if fault == "truncated" else 0
        for x in steps:
            if role[:1] == x:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, after[x], (*out, (role, text))))
            elif x in full:
                heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, after[x], (*out, (full[x], text))))
    raise AssertionError


def by_hand(table):
    """The query in plain Python: (conv, turn, role, text) rows in, one row a conversation out."""
    convs, kept = {r[0] for r in table}, defaultdict(list)
    for conv, turn, role, text in table:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        fate = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        kept[conv] += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv in convs:
        digest = {t: hashlib.sha256(t.encode()).digest() for _, _, t in kept[conv]}
        rows = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest[r[2]]))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.strip(BLANKS)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[:1] for _, r, _ in rows]
        cost, audit, fixed = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(), fixed,
        )
    return out


def test_alignment_is_the_cheapest_and_least():
    r = random.Random(3)
    for _ in range(1500):
        rows = [(r.choice("suuaaax"), r.random() < 0.25) for _ in range(r.randint(0, 9))]
        got = turn_repair.aligned(tuple(rows), 0, turn_repair.ENDS)
        want = cheapest([(role, "t", "truncated" if cut else "") for role, cut in rows])
        assert got == want[:2], rows


@pytest.mark.parametrize("segment", [1, 3, 64])
def test_segments_chain_to_the_same(monkeypatch, segment):
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    r = random.Random(segment)
    for _ in range(250):
        stretch, rows, seen = turn_repair._Stretch(), [], set()
        for k in range(r.randint(0, 12)):
            role, n = r.choice(["system", "user", "user", "assistant", "tool"]), r.choice([1, 1, 1, 1, 2, 3])
            text, fault = f"{k}", r.choice(["", "", "", "truncated", "blank", "duplicate"])
            stretch.add(k, role[0], fault == "blank", fault == "duplicate", fault == "truncated", n)
            rows += [(role, text, fault)] + [(role, text, fault if fault == "blank" else "duplicate")] * (n - 1)
        cost, audit, _ = cheapest(rows)
        whole = stretch.result(open_ends=False)
        assert (whole[-2], whole[-1]) == ([cost], [audit])


SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("conv", "copies", "n", "digest", "audit", "place")]
)


def odd_rows(n, seed=1):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Well!  ", "", " \t", None, "a. b", "Really?", "x:y.\nuser:z", "é…"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(r.choice([1, 2, 5, 6, 8, 9])):
            row = (conv, None if r.random() < 0.05 else turn + (r.random() < 0.05), r.choice(["user", "assistant", "assistant", "system", None, ""]) if r.random() < 0.3 else ("user", "assistant")[turn % 2])
            rows += [(*row, r.choice(texts) if r.random() < 0.4 else f"text {r.randint(0, 30)}.")] * r.choice([1, 1, 1, 1, 2])
    rows += [(-1, t % 700, ("user", "assistant")[t % 2], ("same.", f"turn {t}.", "cut")[t % 3]) for t in range(900)]  # one long conversation
    rows += [(-2, 5, "user", "again and again.")] * 400
    return rows


@pytest.fixture(scope="module")
def odd_turns(spark):
    return odd_rows(120)


def test_query_by_brute_force(spark, odd_turns, tmp_path):
    df = spark.createDataFrame([(*row, *["z"] * 6) for row in odd_turns], SCHEMA).repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    result = op11_turn_repair(spark, str(tmp_path))
    assert result.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert [t for c, t in result.dtypes if c not in ("audit", "repaired_sha256")] == ["bigint"] * 7
    got = {row[0]: tuple(row)[1:] for row in result.collect()}
    want = by_hand(odd_turns)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv][:-1], conv


def test_repaired_turns(spark, odd_turns):
    df = spark.createDataFrame([(*row, *["z"] * 6) for row in odd_turns], SCHEMA)
    rows = turn_repair.damaged(df)
    found = defaultdict(dict)
    for conv, position, role, text in turn_repair.repaired_turns(rows, turn_repair.repair(rows)).collect():
        found[conv][position] = (role, text)
    want = by_hand(odd_turns)
    for conv, row in want.items():
        assert [found[conv][i] for i in range(len(found[conv]))] == list(row[-1])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_turn_repair(spark, str(tmp_path)).count() == 0
