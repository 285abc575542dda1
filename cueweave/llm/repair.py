"""Conversation structure repair by aligning turns to an alternating grammar.

A sound conversation's role initials read ``(s?(ua)+)?``, so for each feasible length
there is exactly one target string.  Turns are aligned to the targets of all lengths by
Wagner-Fischer tables: those of even length are prefixes of "uaua...", those of odd
length of "suaua...", so two tables hold every length.  A first, narrow table gives an
incumbent cost; Ukkonen's band for that cost is then wide enough for the optimum, and of
the cheapest alignments of all lengths the one with the least audit string is taken.

Edits: Keep 0, Rerole (to user or assistant) 2, Delete 3 (a must for blank and duplicate
turns), Insert an empty user or assistant turn 2; a truncated turn that stays adds 1.

Conversations of over ``long_rows`` turns or ``long_bytes`` of text are not held in
memory: a cell depends on its column only through the column's parity, so equal columns
fold into the four states of the grammar, whose costs are swept backwards over one byte
a turn, and the texts are streamed past the audit in a second pass.

Defined results: turns are taken by turn (null first), then role, then text.  A null
role or text is one space; a null conversation identifier is a conversation of its own.
A turn without a non-blank character is blank; else it is a duplicate if its role and
text came before; else truncated if its last non-blank character is none of ``.!?``.
Conversations without turns have zeros, an empty audit and an empty text.  Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.storage import materialise
from cueweave.llm.memory import releasing

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANK = b" \t\n\v\f\r"
LONG_ROWS, LONG_BYTES = 1000, 32 << 20
FIRST_SLACK = 6
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
FAULTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
FAR = 1 << 60


# ---------------------------------------------------------------- one conversation
def symbol(family: int, place: int) -> str:
    """The target's symbol at ``place`` (from 1): family 0 is uaua..., family 1 suaua..."""
    if family and place == 1:
        return "s"
    return "ua"[(place + 1 + family) % 2]


class Table:
    """A banded Wagner-Fischer table of turns against all prefixes of one target family.

    ``turns`` are (initial, must go, truncated).  With ``gone`` turns that must go, a path
    of cost ``3 * gone + slack`` or less stays within slack // 3 columns before and
    slack // 2 behind the number of turns that may stay.
    """

    def __init__(self, turns: list[tuple[str, bool, bool]], family: int, slack: int):
        self.turns, self.family = turns, family
        self.low, self.cells, stay = [], [], 0
        for i in range(len(turns) + 1):
            if i:
                stay += not turns[i - 1][1]
            low, high = max(0, stay - slack // 3), stay + slack // 2
            self.low.append(low)
            row = [FAR] * (high - low + 1)
            for j in range(low, high + 1):
                best = 0 if i == j == 0 else FAR
                if i:
                    best = min(best, self.at(i - 1, j) + DELETE, self.at(i - 1, j - 1) + self.stays(i - 1, j))
                if j > low:
                    best = min(best, row[j - low - 1] + self.inserts(j))
                row[j - low] = min(best, FAR)
            self.cells.append(row)

    def at(self, i: int, j: int) -> int:
        k = j - self.low[i]
        return self.cells[i][k] if 0 <= k < len(self.cells[i]) else FAR

    def stays(self, i: int, j: int) -> int:
        """The cost of matching turn i with column j."""
        initial, gone, cut = self.turns[i]
        want = symbol(self.family, j) if j else ""
        if gone or not want or (want != initial and want == "s"):
            return FAR
        return (KEEP if want == initial else REROLE) + TRUNCATED * cut

    def inserts(self, j: int) -> int:
        return INSERT if symbol(self.family, j) != "s" else FAR

    def totals(self) -> dict[int, int]:
        """The cost of each feasible length of this family."""
        m = len(self.turns)
        first = self.low[m]
        return {j: c for j, c in enumerate(self.cells[m], first) if c < FAR and j % 2 == self.family and j != 1}

    def audit(self, length: int) -> str:
        """The least of the cheapest audits that end at ``length``."""
        m = len(self.turns)
        good = {(m, length)}
        stack = [(m, length)]
        while stack:
            i, j = stack.pop()
            here = self.at(i, j)
            before = [(i, j - 1, self.inserts(j))] if j else []
            if i:
                before += [(i - 1, j, DELETE), (i - 1, j - 1, self.stays(i - 1, j))] if j else [(i - 1, j, DELETE)]
            for a, b, cost in before:
                if (a, b) not in good and self.at(a, b) + cost == here:
                    good.add((a, b))
                    stack.append((a, b))
        out, i, j = [], 0, 0
        while (i, j) != (m, length):
            here = self.at(i, j)
            stays = self.stays(i, j + 1) if i < m else FAR
            kept = i < m and symbol(self.family, j + 1) == self.turns[i][0]
            for letter, a, b, cost in (("D", i + 1, j, DELETE), ("I", i, j + 1, self.inserts(j + 1)), ("K" if kept else "R", i + 1, j + 1, stays)):
                if (a, b) in good and here + cost == self.at(a, b):
                    out.append(letter)
                    i, j = a, b
                    break
        return "".join(out)


def align(turns: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, of equal ones the least audit."""
    must = DELETE * sum(gone for _, gone, _ in turns)
    slack = FIRST_SLACK
    while True:
        tables = [Table(turns, family, slack) for family in (0, 1)]
        totals = [t.totals() for t in tables]
        cost = min((c for own in totals for c in own.values()), default=FAR)
        if cost - must <= slack:
            return cost, min(t.audit(length) for t, own in zip(tables, totals, strict=True) for length, c in own.items() if c == cost)
        slack = cost - must if cost < FAR else 2 * slack


#: The grammar's states: what each symbol leads to.  0 nothing yet, 1 after s, 2 after u, 3 after a.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 4, 2, 0)


def edits(state: int, turn: tuple[str, bool, bool] | None) -> list[tuple[str, int, int, int]]:
    """(letter, turns used, next state, cost) of the edits possible in a state, by letter."""
    want = "a" if state == 2 else "u"
    out = [("I", 0, MOVES[state][want], INSERT)]
    if turn is not None:
        initial, gone, cut = turn
        out.insert(0, ("D", 1, state, DELETE))
        if not gone:
            if initial in MOVES[state]:
                out.append(("K", 1, MOVES[state][initial], KEEP + TRUNCATED * cut))
            out.append(("R", 1, MOVES[state][want], REROLE + TRUNCATED * cut))
    return out


class Turns:
    """Turns at one byte each."""

    def __init__(self) -> None:
        self.codes = bytearray()

    def append(self, turn: tuple[str, bool, bool]) -> None:
        initial, gone, cut = turn
        self.codes.append("sua".find(initial) + 1 if initial else 0)
        self.codes[-1] |= gone << 2 | cut << 3

    def __len__(self) -> int:
        return len(self.codes)

    def __getitem__(self, i: int) -> tuple[str, bool, bool]:
        c = self.codes[i]
        return "-sua"[c & 3], bool(c & 4), bool(c & 8)


def _sweep(turns: Turns, low: int, high: int, after: tuple) -> list[tuple]:
    """The costs to the end from each state before the turns low..high, and after them."""
    costs = [after]
    for i in range(high - 1, low - 1, -1):
        turn, nxt = turns[i], costs[-1]
        now = [min(c + nxt[q] for _, used, q, c in edits(s, turn) if used) for s in range(4)]
        for s in (2, 3, 2, 1, 0):  # insertions lead on within a column
            now[s] = min(now[s], INSERT + now[3 if s == 2 else 2])
        costs.append(tuple(now))
    return costs[::-1]


def align_long(turns: Turns, step: int = 4096) -> tuple[int, str]:
    """As ``align``, in time and memory linear in the number of turns: costs at every
    ``step``-th turn are kept, those between are made again when they are needed."""
    marks = {len(turns): ENDS}
    for high in range(len(turns), 0, -1):
        if high in marks:
            low = max(0, (high - 1) // step * step)
            marks[low] = _sweep(turns, low, high, marks[high])[0]
    out, i, state, low, costs = bytearray(), 0, 0, 0, []
    total = marks[0][0]
    while True:
        if i < len(turns) and (not costs or i - low >= len(costs) - 1):
            low = i
            high = min(len(turns), low // step * step + step)
            costs = _sweep(turns, low, high, marks[high])
        here = costs[i - low] if costs else ENDS
        if i == len(turns) and here[state] == 0:
            return total, out.decode()
        for letter, used, to, cost in edits(state, turns[i] if i < len(turns) else None):
            if here[state] == cost + (costs[i + used - low] if costs else ENDS)[to]:
                out += letter.encode()
                i, state = i + used, to
                break


def repaired_roles(audit: str) -> Iterator[tuple[str, str | None]]:
    """For each letter: it, and the role that Insert and Rerole give."""
    length = sum(letter != "D" for letter in audit)
    place = 0
    for letter in audit:
        place += letter != "D"
        yield letter, ROLES[symbol(length % 2, place)] if letter in "IR" else None


class Inspector:
    """Counts faults of turns that come in order."""

    def __init__(self, long: bool = False):
        self.turns = Turns() if long else []
        self.long, self.seen, self.before = long, set(), None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.last = None
        self.distinct = 0

    def add(self, turn: int | None, role: bytes, text: bytes) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.distinct += turn != self.most
            self.most = turn
        initial = role.decode("utf-8", "replace")[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        bare = text.rstrip(BLANK)
        key = hashlib.sha256(b"%d:" % len(role) + role + text).digest()  # a conversation's texts need not be held
        blank, again = not bare, key in self.seen
        cut = not blank and not again and bare[-1:] not in (b".", b"!", b"?")
        self.seen.add(key)
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut
        self.turns.append((initial, blank or again, cut))

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        cost, audit = (align_long if self.long else align)(self.turns)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def repaired_lines(audit: str, rows: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, bytes]]:
    """The repaired (role, text)s."""
    for letter, role in repaired_roles(audit):
        if letter == "I":
            yield role.encode(), b""
            continue
        own, text = next(rows)
        if letter != "D":
            yield (role.encode() if role else own), text


def hashed(lines: Iterator[tuple[bytes, bytes]]) -> str:
    """SHA-256 of the lines ``role:text``, joined by newlines."""
    digest, first = hashlib.sha256(), True
    for role, text in lines:
        digest.update((b"" if first else b"\n") + role + b":" + text)
        first = False
    return digest.hexdigest()


# ---------------------------------------------------------------- the Spark job
def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    space = F.lit(" ")
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    return rows.select(
        F.col(conv).alias("conv_id"), here.alias("here"), F.when(here, F.col(turn)).cast("long").alias("turn"),
        F.when(here, F.coalesce(F.col(role).cast("string"), space)).alias("role"), F.when(here, F.coalesce(F.col(text).cast("string"), space)).alias("text"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, strings as bytes."""
    for batch in batches:
        columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
        for at in range(0, batch.num_rows, 1000):
            yield from zip(*(c.slice(at, 1000).to_pylist() for c in columns), strict=True)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, its rows one by one) of each conversation in a sorted stream."""
    rows = iter(rows)
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def own() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:  # noqa: B023
                row, ahead = ahead, next(rows, None)
                yield row

        run = own()
        yield key, run
        for _ in run:
            pass


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array([v.decode() if isinstance(v, bytes) and pa.types.is_string(kind) else v for v in values], kind)


def _table(rows: list[tuple], names: str, key: pa.DataType) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * (len(fields) + 1)
    return pa.RecordBatch.from_arrays([_column(list(columns[0]), key)] + [_column(list(c), kinds[k]) for c, (_, k) in zip(columns[1:], fields, strict=True)], ["conv_id", *[n for n, _ in fields]])


def repair_conversations(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present: Column | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES,
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Rows for which ``present`` is not true only name their conversation.
    """
    turns = _prepared(rows, conv_col, turn_col, role_col, text_col, present)
    key = turns.schema["conv_id"].dataType.simpleString()
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes"))
    long = materialise(sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("__long")), "long-conversations")
    some = not long.isEmpty()
    short = turns.join(long, turns["conv_id"].eqNullSafe(long["__long"]), "left_anti") if some else turns

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kind = [], None
        source = iter(batches)
        first = next(source, None)
        if first is None:
            return
        kind = first.schema.field(0).type

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from source

        for conv, own in _conversations(_streamed(every())):
            looked, lines = Inspector(), []
            for _, here, turn, role, text in own:
                if here:
                    looked.add(turn, role, text)
                    lines.append((role, text))
            found = looked.result()
            out.append((conv, *found, hashed(repaired_lines(found[-1], iter(lines)))))
            if len(out) >= 1000:
                yield _table(out, f"{FAULTS}, repaired_sha256 string", kind)
                out = []
        yield _table(out, f"{FAULTS}, repaired_sha256 string", kind)

    schema = f"conv_id {key}, {FAULTS}, repaired_sha256 string"
    done = _in_order(short).mapInArrow(run, schema)
    return done.unionByName(_repair_long(turns.join(long, turns["conv_id"].eqNullSafe(long["__long"]), "left_semi"), key)) if some else done


def _repair_long(turns: DataFrame, key: str) -> DataFrame:
    """As ``repair_conversations`` for conversations that no task holds: an audit in a first
    pass, then it goes ahead of the turns, whose texts are hashed as they come."""

    @releasing
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for conv, own in _conversations(_streamed(seen())):
            looked = Inspector(long=True)
            for _, here, turn, role, text in own:
                if here:
                    looked.add(turn, role, text)
            yield _table([(conv, *looked.result())], FAULTS, kind)

    audits = materialise(_in_order(turns).mapInArrow(audit, f"conv_id {key}, {FAULTS}"), "long-audits")
    both = audits.select("conv_id", F.lit(0).alias("side"), "audit").unionByName(turns.filter("here").select("conv_id", F.lit(1).alias("side"), "turn", "role", "text"), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "side", F.asc_nulls_first("turn"), "role", "text")

    @releasing
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for conv, own in _conversations(_streamed(seen())):
            letters = next(own)[2].decode()
            yield _table([(conv, hashed(repaired_lines(letters, ((r[4], r[5]) for r in own))))], "repaired_sha256 string", kind)

    hashes = both.mapInArrow(digest, f"conv_id {key}, repaired_sha256 string").withColumnRenamed("conv_id", "__conv")
    return audits.join(hashes, audits["conv_id"].eqNullSafe(hashes["__conv"])).drop("__conv")


def repaired_turns(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long_rows: int = LONG_ROWS) -> DataFrame:
    """(conv_id, place, edit, role, text) of the repaired conversations, a row for each turn."""
    turns = _prepared(rows, conv_col, turn_col, role_col, text_col, None)
    key = turns.schema["conv_id"].dataType.simpleString()
    audits = repair_conversations(rows, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col, long_rows=long_rows)
    both = audits.select("conv_id", F.lit(0).alias("side"), "audit").unionByName(turns.select("conv_id", F.lit(1).alias("side"), "turn", "role", "text"), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "side", F.asc_nulls_first("turn"), "role", "text")
    names = "place long, edit string, role string, text string"

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        out = []
        for conv, own in _conversations(_streamed(seen())):
            letters = next(own)[2].decode()
            kept = (x for x in letters if x != "D")
            for place, (edit, (role, text)) in enumerate(zip(kept, repaired_lines(letters, ((r[4], r[5]) for r in own)), strict=True)):
                out.append((conv, place, edit, role, text))
                if len(out) >= 1000:
                    yield _table(out, names, kind)
                    out = []
        if out:
            yield _table(out, names, kind)

    return both.mapInArrow(run, f"conv_id {key}, {names}")


# ---------------------------------------------------------------- damage
def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with faults by crc32("conv_id:turn") % 20: 0 takes a row out (``here`` is
    false), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes the role user.
    Nulls are one space (a null turn stays null)."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("here"), "kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).drop("kind", "copy")
