"""Conversation structure repair by depth-first branch-and-bound.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Each row's first fault counts: blank
(no character but white space), duplicate (role and text seen earlier) or truncated (its last such character is none
of ``.!?``). Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (a must for blank and duplicate rows), Insert an
empty user or assistant turn 5; a truncated row that stays adds 5. The audit is the string of the initials of the cheapest
edits in order, the least in ASCII of equally cheap ones. It fixes the roles, so there is one repair.

1. *Search* (``cheapest``). Nodes are prefixes of the rows with the state of the roles so far. An explicit stack goes depth
   first, most promising child first. A suffix lower bound (the cheapest edits of the rows left if audits are not compared and a
   conversation may also end after its system turn) cuts nodes that cannot beat the incumbent (cost, audit), and a dominance table drops a prefix that reaches a node with no better (cost, audit).
   The search ends when the stack is empty, which proves the incumbent. No two inserts stand between two rows: without both
   (or without a lone system row) the conversation is cheaper.
2. *Pieces*. Conversations can be of any length, so rows are ordered by range and cut every 4,096 rows (``PIECE_BITS``). A conversation in
   one piece is searched as it is. Of others, each piece is searched from each state to each state, and gives 16 costs and the
   order of its audits. Inserts belong to the piece of the row behind them, so that no audit up to a boundary begins another
   one, and the order of audits up to a boundary decides that of whole audits. A fold over these rows of numbers
   picks the states at the boundaries, and the pieces are searched again between these.
3. *Replay*. Rows and audits are brought together in order and streamed; nothing but the current row and the audit is held.

Scale. Rows are sorted once by range on (conversation, turn, digest, a number that spreads equal rows), written, and then
known by their place; first occurrences are a partial aggregate joined on the place. One conversation's pieces are
folded in one task, one row of 32 numbers for 4,096 rows, and its digest is one stream, as SHA-256 is sequential.

Edge cases. Null roles and texts count as one space. Rows are taken by turn, nulls first, then by the MD5 of role and text;
equal rows are duplicates. Rows without a conversation id form one conversation. A conversation whose rows are all dropped
has zeros, an empty audit and the hash of nothing. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.shared import written

PIECE_BITS = 12
# Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Roles (other, system, user, assistant) and faults of a row's code: role + 4 * fault.
SYSTEM, USER, ASSISTANT = 1, 2, 3
CUT_OFF, REPEATED, BLANK = 1, 2, 3
# States: nothing yet, a system turn, a user turn last, an assistant turn last.
NOTHING, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: Where a conversation may end: state -> (extra cost, extra audit).
ENDINGS = {NOTHING: (0, ""), AFTER_ASSISTANT: (0, ""), AFTER_USER: (INSERT, "I")}
WHITE = " \t\n\x0b\f\r"


# ---------------------------------------------------------------- the search

def _turn(state: int) -> int:
    """The state after the turn that comes next in this state: that of the user, or of the assistant after one."""
    return AFTER_ASSISTANT if state == AFTER_USER else AFTER_USER


def _edits(code: int, state: int) -> list[tuple[int, str, int]]:
    """(cost, initial, next state) of the edits of a row."""
    role, fault = code & 3, code >> 2
    out = [(DELETE, "D", state)]
    if fault < REPEATED:
        extra = TRUNCATED if fault == CUT_OFF else 0
        then = _turn(state)
        if role == SYSTEM and state == NOTHING:
            out.append((KEEP + extra, "K", AFTER_SYSTEM))
        if role == then:  # the numbers of the roles are those of the states they lead to
            out.append((KEEP + extra, "K", then))
        else:
            out.append((REROLE + extra, "R", then))
    return out


def suffix_bounds(codes: bytes, endings: Mapping[int, tuple[int, str]]) -> list[tuple[float, float, float, float]]:
    """For each number of rows done, by state: the least cost of the rest, if a conversation might also end after its system turn."""
    most = float("inf")
    assistant = endings.get(AFTER_USER, (most, ""))[0]
    user = min((endings[s][0] for s in (AFTER_SYSTEM, AFTER_ASSISTANT) if s in endings), default=most)
    begin = endings.get(NOTHING, (most, ""))[0]
    out = [(begin, user, assistant, user)]
    for code in reversed(codes):
        role, fault = code & 3, code >> 2
        a, b, c = user + DELETE, assistant + DELETE, begin + DELETE
        if fault < REPEATED:
            extra = TRUNCATED if fault == CUT_OFF else 0
            start = extra + assistant + (KEEP if role == USER else REROLE)
            a, c = min(a, start), min(c, start, extra + user if role == SYSTEM else most)
            b = min(b, extra + user + (KEEP if role == ASSISTANT else REROLE))
        begin, user, assistant = min(c, b + INSERT), min(a, b + INSERT), min(b, a + INSERT)
        out.append((begin, user, assistant, user))
    return out[::-1]


def cheapest(codes: bytes, entry: int = NOTHING, endings: Mapping[int, tuple[int, str]] = ENDINGS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that lead from a state to one of the endings; None if none do."""
    bounds, n = suffix_bounds(codes, endings), len(codes)
    best: tuple[float, str] = (float("inf"), "")
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        bound = cost + bounds[i][state]
        if bound > best[0] or bound == best[0] and (bound == float("inf") or audit > best[1][:len(audit)]):
            continue
        seen = table.get((i, state))
        if seen is not None and seen <= (cost, audit):
            continue
        table[i, state] = cost, audit
        if i == n:
            if state in endings:
                best = min(best, (cost + endings[state][0], audit + endings[state][1]))
            continue
        code, then = codes[i], _turn(state)
        children = [(cost + c, audit + e, s) for c, e, s in _edits(code, state)]
        children += [(cost + INSERT + c, audit + "I" + e, s) for c, e, s in _edits(code, then)]
        children.sort(key=lambda x: (x[0] + bounds[i + 1][x[2]], x[1]), reverse=True)
        stack += [(i + 1, s, c, e) for c, e, s in children]
    return None if best[0] == float("inf") else best


def piece_table(codes: bytes) -> tuple[list[int], list[int]]:
    """Costs from each state to each state (16, -1 where there is no way), and the place of each audit among those from its first state."""
    costs, order = [], []
    for entry in range(4):
        found = [cheapest(codes, entry, {x: (0, "")}) for x in range(4)]
        ranked = sorted(f[1] for f in found if f)
        costs += [f[0] if f else -1 for f in found]
        order += [ranked.index(f[1]) if f else -1 for f in found]
    return costs, order


def fold(tables: Iterator[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """(entry, exit) state of each piece of a conversation on the cheapest way."""
    ways = {NOTHING: (0, 0)}  # state -> (cost, place among the audits so far)
    back: list[dict[int, int]] = []
    for costs, order in tables:
        found = {}
        for x in range(4):
            options = [(c + costs[4 * m + x], place, m) for m, (c, place) in ways.items() if costs[4 * m + x] >= 0]
            if options:
                found[x] = min(options)
        places = sorted(found, key=lambda x: (found[x][1], order[4 * found[x][2] + x]))
        ways = {x: (found[x][0], places.index(x)) for x in found}
        back.append({x: found[x][2] for x in found})
    _, _, state = min((c + ENDINGS[x][0], place, x) for x, (c, place) in ways.items() if x in ENDINGS)
    out = []
    for step in reversed(back):
        out.append((step[state], state))
        state = step[state]
    return out[::-1]


# ---------------------------------------------------------------- rows, codes, pieces

def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Transcripts with planted faults, by the CRC-32 of ``id:turn`` modulo 20 (nulls: one space): 0 drops the row (``alive`` is false),
    1 empties its text, 2 removes the sentence ends, 3 repeats it, 4 sets its role to user."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    kind = F.crc32(named.cast("binary")) % 20
    text = F.coalesce(F.col(text_col).cast("string"), space)
    rows = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                       F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role_col).cast("string"), space)).alias("role"),
                       F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                       kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("alive"), copies.alias("copy")).drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """The rows in order, written, with their place and their role and faults but for repetition. rows: conv_id, turn, role, text, alive."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), F.when(F.col("alive"), text).alias("text"), "alive")
    rows = rows.withColumns({"same": F.unhex(F.md5(F.concat(F.md5(F.col("role").cast("binary")), F.coalesce("text", F.lit(""))).cast("binary"))),
                             "spread": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "same", "spread"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return written(rows.drop("spread"), "transcript")


def _code() -> Column:
    body = F.rtrim("text", F.lit(WHITE))
    first = F.left("role", F.lit(1))
    role = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)
    fault = (F.when(body == "", BLANK).when(F.col("repeated"), REPEATED)
             .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), CUT_OFF).otherwise(0))
    return role + 4 * fault


def audits(rows: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """(conv_id, at, codes, cost, audit) of each piece of 2 ** piece_bits places; ``at`` is the place of its first row. rows: ``placed``."""
    alive = rows.where("alive")
    firsts = alive.groupBy("conv_id", "same").agg(F.min("at").alias("at")).select("at", F.lit(False).alias("repeated"))
    coded = alive.join(firsts, "at", "left").withColumn("repeated", F.coalesce("repeated", F.lit(True))).select("conv_id", "at", _code().alias("code"))
    listed = F.sort_array(F.collect_list(F.struct("at", "code")))
    pieces = coded.groupBy("conv_id", F.shiftright("at", piece_bits).alias("piece")).agg(listed.alias("rows"))
    pieces = pieces.select("conv_id", F.col("rows")[0]["at"].alias("at"), F.array_join(F.transform("rows", lambda r: F.char(r["code"] + 65)), "").alias("codes"))
    counts = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).where("n > 1").select("conv_id")
    key = lambda df: df.withColumn("_key", F.struct("conv_id"))  # noqa: E731  a struct, as null ids are equal too
    pieces = written(key(pieces).join(key(counts).select("_key", F.lit(True).alias("several")), "_key", "left").drop("_key"), "transcript-pieces")
    one, several = pieces.where("several IS NULL").drop("several"), pieces.where("several").drop("several")

    schema = T.StructType([one.schema["conv_id"], T.StructField("at", T.LongType()), T.StructField("codes", T.StringType()),
                           T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(2).to_pylist()
            known = {c: cheapest(_codes(c)) for c in set(codes)}
            found = [known[c] for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=schema.names)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for codes, entry, leave, last in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                extra = ENDINGS[leave] if last else (0, "")
                found.append(cheapest(_codes(codes), entry, {leave: extra}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=schema.names)

    tables = several.mapInArrow(_tables, T.StructType([one.schema["conv_id"], T.StructField("at", T.LongType()), T.StructField("table", T.ArrayType(T.LongType()))]))
    ways = tables.groupBy("conv_id").applyInArrow(_fold_group, "at long, entry long, leave long, last boolean")
    return one.mapInArrow(solve, schema).unionAll(several.join(ways, "at").select("conv_id", "at", "codes", "entry", "leave", "last").mapInArrow(between, schema))


def _codes(text: str) -> bytes:
    return bytes(b - 65 for b in text.encode())


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sum(piece_table(_codes(c)), []) for c in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "at", "table"])


def _fold_group(table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    at, rows = table.column("at"), table.column("table").combine_chunks()
    flat = rows.flatten().to_numpy().reshape(-1, 32)
    ways = fold((r[:16].tolist(), r[16:].tolist()) for r in flat)
    entry, leave = zip(*ways)
    last = np.zeros(len(ways), bool)
    last[-1] = True
    return pa.table([at, pa.array(entry, pa.int64()), pa.array(leave, pa.int64()), pa.array(last)], names=["at", "entry", "leave", "last"])


# ---------------------------------------------------------------- replay

class Replay:
    """Applies audits to the rows of one conversation, in order."""

    def __init__(self) -> None:
        self.state, self.audit, self.next = NOTHING, "", 0

    def take(self, audit: str) -> None:
        self.audit, self.next = audit, 0

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.next < len(self.audit) and self.audit[self.next] == "I":
            self.next += 1
            self.state = _turn(self.state)
            yield "I", "user" if self.state == AFTER_USER else "assistant", ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that an input row leaves, inserted ones before it included."""
        yield from self._inserted()
        edit = self.audit[self.next]
        self.next += 1
        if edit == "D":
            return
        if edit == "R":
            self.state = _turn(self.state)
            role = "user" if self.state == AFTER_USER else "assistant"
        else:
            self.state = {"s": AFTER_SYSTEM, "u": AFTER_USER, "a": AFTER_ASSISTANT}[role[0]]
        yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _together(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows and audits of each conversation in one partition, in order; an audit stands before the first row of its piece."""
    none = lambda t: F.lit(None).cast(t)
    both = rows.select("conv_id", "at", F.lit(1).alias("tag"), "turn", "role", "text", "alive", none("string").alias("codes"), none("long").alias("cost"), none("string").alias("audit"))
    both = both.unionAll(found.select("conv_id", "at", F.lit(0).alias("tag"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"),
                                      none("boolean").alias("alive"), "codes", "cost", "audit"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at", "tag")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(whether a conversation begins, row) of sorted batches."""
    last: tuple = ()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield (row[0],) != last, row
            last = (row[0],)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of every turn of the repaired conversations."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        replay, place, conv = Replay(), 0, None

        def add(turns, conv):
            nonlocal place
            for turn in turns:
                out.append((conv, place, *turn))
                place += 1

        for new, (own, _, tag, _, role, text, alive, _, _, audit) in _groups(batches):
            if new:
                add(replay.end(), conv)
                replay, place, conv = Replay(), 0, own
            if tag == 0:
                add(replay.end(), conv)  # nothing: only the last audit ends with an insert
                replay.take(audit)
            elif alive:
                add(replay.row(role, text), conv)
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
        add(replay.end(), conv)
        if out:
            yield _batch(out, schema)

    return _together(rows, found).mapInArrow(run, schema)


def repair_summary(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per conversation: gaps in the turns, faults, illegal neighbours, cost, audit and a digest of the repaired conversation."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in counts),
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        own: Summary | None = None
        for new, row in _groups(batches):
            if new:
                if own:
                    out.append(own.result())
                own = Summary(row[0])
            own.add(row)
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
        if own:
            out.append(own.result())
        if out:
            yield _batch(out, schema)

    return _together(rows, found).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), schema)], names=schema.names)


class Summary:
    """Running figures of one conversation."""

    LEGAL = frozenset(("su", "ua", "au"))

    def __init__(self, conv) -> None:
        self.conv, self.replay, self.hash, self.lines = conv, Replay(), hashlib.sha256(), 0
        self.first = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.faults = [0, 0, 0, 0]
        self.before: str | None = None
        self.audit: list[str] = []

    def _write(self, turns) -> None:
        for _, role, text in turns:
            self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def add(self, row: tuple) -> None:
        _, _, tag, turn, role, text, alive, codes, cost, audit = row
        if tag == 0:
            self.replay.take(audit)
            self.audit.append(audit)
            self.cost += cost
            for code in _codes(codes):
                self.faults[code >> 2] += 1
        elif alive:
            if turn is not None:
                if turn != self.last:
                    self.turns += 1
                self.first, self.last = turn if self.first is None else self.first, turn
            if self.before is not None and self.before + role[:1] not in self.LEGAL:
                self.illegal += 1
            self.before = role[:1]
            self._write(self.replay.row(role, text))

    def result(self) -> tuple:
        self._write(self.replay.end())
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, self.faults[BLANK], self.faults[REPEATED], self.faults[CUT_OFF], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())
