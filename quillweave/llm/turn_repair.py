"""Conversation structure repair by Wagner-Fischer alignment with target strings.

A well-formed conversation is nothing, or one optional system turn and then user and
assistant turns in alternation, ending with the assistant.  Turns are aligned with each
feasible length of that target.  A table of edit costs is filled only inside Ukkonen's band,
the diagonals that the cheapest alignment known so far can still reach; targets whose length
alone costs more are passed over.  Of equally cheap alignments the ASCII-least backtraced audit
(D, I, K, R in order of the edits) is taken.

**Long conversations.**  Rows are range-partitioned by conversation and turn, and cut into
segments of ``SEGMENT`` rows.  A segment that isn't a whole conversation is aligned between each
pair of grammar states at its borders; two audits of equal cost over the same rows never are
prefixes of each other, so segments chain by (cost, audit), first inside a task, then, one
piece a task, by conversation.  No task holds a conversation's texts: the last step streams
them, sorted, through a hash.  An audit is one cell of the result, so it has to fit one (2 GB).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillweave.llm.common import keep, ship

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: rows of one alignment table
SEGMENT = 64
#: grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn
STATES = 4
ENDS = (0, 3)
BLANKS = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
_LEGAL = ("su", "ua", "au")

Rows = tuple[tuple[str, bool], ...]
Piece = tuple[int, str]


def targets(start: int, end: int, most: int) -> list[str]:
    """The grammar's strings of at most ``most`` turns that lead from one state to another."""
    found = []
    for head in ("", "s") if start == 0 else ("",):
        letters = "au" if start == 2 else "ua"
        state = 1 if head else start
        for n in range(most - len(head) + 1):
            if state == end:
                found.append(head + (letters * (n // 2 + 1))[:n])
            state = 2 if letters[n % 2] == "u" else 3
    return found


def _least(turns: int, target: int) -> int:
    """What the difference of lengths costs."""
    return INSERT * (target - turns) if target >= turns else DELETE * (turns - target)


def _banded(rows: Rows, target: str, bound: int) -> tuple[list[list[int]], int]:
    """Costs from each cell (turns, target turns) on, in the band that ``bound`` allows; its lowest diagonal."""
    n, m = len(rows), len(target)
    spare = (bound - _least(n, m)) // (INSERT + DELETE)
    low, high = min(0, m - n) - spare, max(0, m - n) + spare
    width = high - low + 1
    table: list[list[int]] = []
    below = [_FAR] * (width + 1)
    for i in range(n, -1, -1):
        line = [_FAR] * (width + 1)  # a cell's place is its diagonal: the one below is one place left
        role, cut = rows[i] if i < n else ("", False)
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            at = j - i - low
            cost = 0 if i == n and j == m else _FAR
            if i < n:
                if at:
                    cost = min(cost, DELETE + below[at - 1])
                if j < m:
                    kept = 0 if role == target[j] else REROLE if target[j] != "s" else _FAR
                    cost = min(cost, kept + (TRUNCATED if cut else 0) + below[at])
            if j < m and target[j] != "s" and at + 1 < width:
                cost = min(cost, INSERT + line[at + 1])
            line[at] = cost
        table.append(line)
        below = line
    table.reverse()
    return table, low


def _audit(rows: Rows, target: str, table: list[list[int]], low: int) -> str:
    """The ASCII-least of the cheapest edits that the table holds."""
    n, m, i, j = len(rows), len(target), 0, 0
    letters = []
    while i < n or j < m:
        at, cost = j - i - low, table[i][j - i - low]
        if i < n and at and cost == DELETE + table[i + 1][at - 1]:
            letters.append("D")
            i += 1
        elif j < m and target[j] != "s" and at + 1 < len(table[i]) and cost == INSERT + table[i][at + 1]:
            letters.append("I")
            j += 1
        else:
            letters.append("K" if rows[i][0] == target[j] else "R")
            i, j = i + 1, j + 1
    return "".join(letters)


@lru_cache(maxsize=1 << 14)
def aligned(rows: Rows, start: int, ends: tuple[int, ...]) -> Piece | None:
    """(cost, audit) of the cheapest way from ``start`` to one of ``ends``: rows are (initial, truncated)."""
    n = len(rows)
    best: Piece | None = None
    by_cost = sorted((_least(n, len(t)), t) for end in ends for t in targets(start, end, 2 * n + 3 if n else 3))
    for least, target in by_cost:
        if best is not None and least > best[0]:
            break  # so does every longer or shorter one
        bound = best[0] if best is not None else least + 2 * (INSERT + DELETE)
        everything = (DELETE + REROLE + TRUNCATED) * n + INSERT * len(target)
        while True:
            table, low = _banded(rows, target, bound)
            cost = table[0][-low]
            if cost <= bound or best is not None or bound >= everything:
                break
            bound *= 2  # nothing is known yet, and the band was too narrow to tell
        if cost >= _FAR or best is not None and cost > best[0]:
            continue
        found = (cost, _audit(rows, target, table, low))
        best = found if best is None else min(best, found)
    return best


class _Row:
    """Equal rows of one turn: the first, and how many more, which are only deleted."""

    __slots__ = ("initial", "cut", "gone", "more")

    def __init__(self, initial: str, cut: bool, gone: bool, more: int):
        self.initial, self.cut, self.gone, self.more = initial, cut, gone, more


def _woven(rows: list[_Row], piece: Piece | None) -> Piece | None:
    """The piece of the rows that may stay, with the deletions of those that may not."""
    if piece is None:
        return None
    out, at = [], 0

    def gone() -> None:
        nonlocal at
        while at < len(rows) and rows[at].gone:
            out.append("D" * (1 + rows[at].more))
            at += 1

    for letter in piece[1]:
        gone()
        out.append(letter)
        if letter != "I":
            out.append("D" * rows[at].more)
            at += 1
    gone()
    forced = sum(r.more + r.gone for r in rows)
    return piece[0] + DELETE * forced, "".join(out)


def _chained(first: list[Piece | None], second: list[Piece | None]) -> list[Piece | None]:
    """Pieces between all states over two neighbouring stretches."""
    out = []
    for p in range(STATES):
        for q in range(STATES):
            ways = [(a[0] + b[0], a[1] + b[1]) for k in range(STATES) if (a := first[p * STATES + k]) and (b := second[k * STATES + q])]
            out.append(min(ways, default=None))
    return out


class _Stretch:
    """Rows of one conversation that lie next to each other, as they come."""

    def __init__(self) -> None:
        self.rows: list[_Row] = []
        self.done: list[tuple[int, list[Piece | None]]] = []  # (segments, pieces), as a binary counter holds them
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first: str | None = None
        self.last: str | None = None
        self.first_turn: int | None = None
        self.last_turn: int | None = None

    def add(self, turn: int | None, initial: str, blank: bool, repeated: bool, truncated: bool, n: int) -> None:
        if not n:
            return
        gone = blank or repeated
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n if repeated else n - 1
        self.truncated += truncated and not gone
        self.illegal += (self.last is not None and self.last + initial not in _LEGAL) + (n - 1) * (initial * 2 not in _LEGAL)
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.distinct += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if len(self.rows) >= SEGMENT:
            self._close()
        self.rows.append(_Row(initial, truncated, gone, n - 1))

    def _between(self, start: int, ends: tuple[int, ...]) -> Piece | None:
        core = tuple((r.initial, r.cut) for r in self.rows if not r.gone)
        return _woven(self.rows, aligned(core, start, ends))

    def _close(self) -> None:
        pieces = [self._between(p, (q,)) for p in range(STATES) for q in range(STATES)]
        self.rows, size = [], 1
        while self.done and self.done[-1][0] <= size:
            n, before = self.done.pop()
            pieces, size = _chained(before, pieces), size + n
        self.done.append((size, pieces))

    def result(self, open_ends: bool) -> tuple:
        """Columns of ``_PIECES`` after the place; the pieces only if something may come before or after."""
        if open_ends or self.done:
            self._close()
            pieces = None
            for _, part in reversed(self.done):
                pieces = part if pieces is None else _chained(part, pieces)
            if not open_ends:
                pieces = [min(p for q in ENDS if (p := pieces[q]))]
        else:
            pieces = [self._between(0, ENDS)]
        counts = self.blank, self.duplicate, self.truncated, self.illegal, self.distinct
        costs, audits = [p and p[0] for p in pieces], [p and p[1] for p in pieces]
        return not open_ends, *counts, self.first, self.last, self.first_turn, self.last_turn, costs, audits


_PIECES = pa.schema(
    [
        ("place", pa.int64()), ("whole", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
        ("distinct", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
        ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    ]
)
_PIECES_SQL = (
    "place bigint, whole boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct bigint, "
    "first string, last string, first_turn bigint, last_turn bigint, costs array<bigint>, audits array<string>"
)
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _pieces(key_type: pa.DataType):
    """Sorted rows to one row a conversation and task; a task's first and last may go on in other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        key, stretch, starts_here = None, None, False
        out: list[tuple] = []

        def table() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            arrays = [pa.array(columns[0], key_type)] + [pa.array(c, f.type) for c, f in zip(columns[1:], _PIECES)]
            return pa.RecordBatch.from_arrays(arrays, names=["conv", *_PIECES.names])

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if stretch is None or conv != key:
                    if stretch is not None:
                        out.append((key, place, *stretch.result(open_ends=not starts_here)))
                        place += 1
                        starts_here = True
                        if len(out) >= 4096:
                            yield table()
                    key, stretch = conv, _Stretch()
                stretch.add(*row)
        if stretch is not None:
            out.append((key, place, *stretch.result(open_ends=True)))
            yield table()

    return run


def _joined(key_type: pa.DataType):
    """The pieces of one conversation, a few a task, to its row."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("place").to_pylist()
        total = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal", "distinct")}
        layer = [[c if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])] for r in rows]
        while len(layer) > 1:
            layer = [_chained(*layer[k : k + 2]) if k + 1 < len(layer) else layer[k] for k in range(0, len(layer), 2)]
        cost, audit = min(p for q in ENDS if (p := layer[0][q]))
        last, last_turn, first_turn = None, None, None
        for r in rows:
            if last is not None and r["first"] is not None:
                total["illegal"] += last + r["first"] not in _LEGAL
            last = r["last"] if r["last"] is not None else last
            if r["first_turn"] is not None:
                total["distinct"] -= r["first_turn"] == last_turn
                first_turn = r["first_turn"] if first_turn is None else first_turn
                last_turn = r["last_turn"]
        row = {"conv": rows[0]["conv"], "first_turn": first_turn, "last_turn": last_turn, "cost": cost, "audit": audit, **total}
        kinds = {"conv": key_type, "audit": pa.string()}
        return pa.table({c: pa.array([row[c]], kinds.get(c, pa.int64())) for c in _JOINED})

    return run


_JOINED = ("conv", "blank", "duplicate", "truncated", "illegal", "distinct", "first_turn", "last_turn", "cost", "audit")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, None, None) for each audit and then (conv, role, text) for each repaired turn, as sorted rows come."""
    audit, at, place, odd, key = "", 0, 0, False, None

    def role() -> str:
        return "user" if (place - odd) % 2 == 0 else "assistant"

    def inserts() -> Iterator[tuple]:
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            yield key, role(), ""
            at, place = at + 1, place + 1

    for batch in batches:
        for conv, said, spoken, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if said is not None:
                yield from inserts()
                key, audit, at, place = conv, said, 0, 0
                odd = (len(audit) - audit.count("D")) % 2 == 1  # only a system turn makes the length odd
                yield key, None, None
                continue
            for _ in range(copies):
                yield from inserts()
                letter = audit[at]
                if letter != "D":
                    yield key, spoken if letter == "K" else role(), text
                    place += 1
                at += 1
    yield from inserts()


def _hashes(key_type: pa.DataType):
    """One digest of the repaired text a conversation, taken turn by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def table() -> pa.RecordBatch:
            columns = [[k for k, _ in done], [d.hexdigest() for _, d in done]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), pa.array(columns[1], pa.string())], names=["conv", "repaired_sha256"])

        between = b""
        for conv, role, text in _edited(batches):
            if role is None:
                if len(done) >= 4096:
                    yield table()
                    done = []
                done.append((conv, hashlib.sha256()))
                between = b""
            else:
                done[-1][1].update(between + f"{role}:{text}".encode())
                between = b"\n"
        if done:
            yield table()

    return run


def _turns(key_type: pa.DataType):
    """The repaired turns themselves."""
    kinds = {"conv": key_type, "position": pa.int64(), "role": pa.string(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        place = 0
        for conv, role, text in _edited(batches):
            if role is None:
                place = 0
                continue
            done.append((conv, place, role, text))
            place += 1
            if len(done) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds.values())], names=list(kinds))
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds.values())], names=list(kinds))

    return run


def damaged(df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows after the seeded damage; a dropped row has no copies.

    A null counts as one space, in the text that the damage is drawn from too; the key and the
    turn themselves stay null.
    """
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(plain(key), F.lit(":"), plain(turn)).cast("binary")) % 20
    said = F.when(fate == 1, "").when(fate == 2, F.translate(plain(text), ".!?", "")).otherwise(plain(text))
    return df.select(
        F.col(key).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.when(fate == 4, "user").otherwise(plain(role)).alias("role"),
        said.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (conv, turn, role, text, copies): counts, cost, audit and the digest of the repaired text.

    Turns go by number, nulls first, equal ones by role and then by the SHA-256 of their text.
    Null roles and texts count as one space; a row of no copies only says that its conversation
    exists.  A role is told by its first letter, and what is none of s, u and a is rewritten or
    deleted.  Equal rows are one row with a count, so a turn repeated without end is no long
    list.  A null conversation is one of its own; an empty table gives no rows; other columns
    don't matter.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = _plain(rows)
    key_type = to_arrow_type(rows.schema["conv"].dataType)
    key_sql = rows.schema["conv"].dataType.simpleString()

    spoken = F.rtrim("text", F.lit(BLANKS))
    marks = rows.select(
        "conv", "turn", "role", "digest", "copies", (spoken == "").alias("blank"), (~F.substring(spoken, -1, 1).isin(".", "!", "?")).alias("truncated")
    )
    marks = marks.groupBy("conv", "turn", "role", "digest", "blank", "truncated").agg(F.sum("copies").alias("n"))
    marks = keep(marks, "repair-marks")
    # what is said in several turns, and the first of them; null sorts before any number
    again = marks.filter("n > 0").groupBy("conv", "role", "digest").agg(F.count("*").alias("turns"), F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"))
    again = again.filter("turns > 1").select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    same = marks["conv"].eqNullSafe(again["_conv"]) & (marks["role"] == again["_role"]) & (marks["digest"] == again["_digest"])
    told = marks.join(again, same, "left")
    repeated = F.coalesce(F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn")), F.lit(False))
    told = keep(told.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "blank", repeated.alias("repeated"), "truncated", "n", "role", "digest"), "repair-told")

    order = ["conv", "turn", "role", "digest"]
    dealt = told.repartitionByRange(*order).sortWithinPartitions(*order).drop("role", "digest")
    pieces = keep(dealt.mapInArrow(_pieces(key_type), f"conv {key_sql}, {_PIECES_SQL}"), "repair-pieces")
    columns = [*_JOINED[:-2], F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit")]
    joined_sql = f"conv {key_sql}, " + ", ".join(f"{c} bigint" for c in _JOINED[1:-1]) + ", audit string"
    parts = pieces.filter("not whole").groupBy("conv").applyInArrow(_joined(key_type), joined_sql)
    audits = keep(pieces.filter("whole").select(*columns).unionByName(parts), "repair-audits")

    both = _streamed(rows, audits)
    hashes = both.mapInArrow(_hashes(key_type), f"conv {key_sql}, repaired_sha256 string")
    hashes = hashes.withColumnRenamed("conv", "_conv")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    return audits.join(hashes, audits["conv"].eqNullSafe(hashes["_conv"])).select("conv", gaps, *_COUNTS[1:], "audit", "repaired_sha256")


def _plain(rows: DataFrame) -> DataFrame:
    space = F.lit(" ")
    named = rows.select("conv", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), "copies")
    return named.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, conversations side by side in a partition."""
    none = {"turn": "bigint", "role": "string", "digest": "binary", "text": "string", "copies": "int"}
    first = audits.select("conv", "audit", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    lines = rows.filter("copies > 0").select("conv", F.lit(None).cast("string").alias("audit"), *(F.col(c).cast(t).alias(c) for c, t in none.items()))
    both = first.unionByName(lines).withColumn("kind", F.col("audit").isNull()).repartition("conv")
    return both.sortWithinPartitions("conv", "kind", "turn", "role", "digest").select("conv", "audit", "role", "text", "copies")


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv, position, role, text): the turns that the audits of ``repairs`` make of ``rows``."""
    ship(rows.sparkSession)
    key = rows.schema["conv"].dataType
    both = _streamed(_plain(rows), repairs.select("conv", "audit"))
    return both.mapInArrow(_turns(to_arrow_type(key)), f"conv {key.simpleString()}, position bigint, role string, text string")
