"""Transcript parsing: roles by a hidden Markov model, then canonical turns.

A transcript is the ordered text chunks of one id, read line by line; where one
chunk ends and the next begins tells the model nothing. Each line has a hidden
state, a role together with "begins a turn" or "continues it", and emits features:
the kind of speaker marker it starts with, its length class, how it starts and how
it ends. The model's tables are smoothed counts over all labelled transcripts;
Viterbi finds the best states.

Plan. One transcript may hold a third of all rows, so no transcript is decoded in
one piece. Rows are dealt by (id, segment of ``segment_rows`` chunk positions). A
first pass turns each segment into its max-plus matrix (best log probability from
a state before it to a state at its end). Matrices of one transcript are combined
in groups of ``fan_in`` up to one, then the best entry and exit state of each
segment comes back down the same levels, and a second pass decodes each segment
alone between its two states. The result equals Viterbi over the whole transcript.

Edge cases. Null text and text without a character other than white space are
lines like any other (empty). Null ids form one transcript; null positions come
first; equal positions are ordered by text; repeated rows are repeated lines.
Unknown roles are left out of the training. Without labelled rows all tables are
flat and the first line is a turn of the first role. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.shared import written

ROLES = ("system", "user", "assistant")
#: Speaker names by role, as they are found in transcripts (fixed values).
MARKERS = {"system": ("system", "system prompt", "context", "instructions"),
           "user": ("user", "human", "q", "question", "prompt", "instruction", "customer"),
           "assistant": ("assistant", "ai", "a", "answer", "response", "bot", "model")}
_KIND = {name: 1 + i for i, role in enumerate(ROLES) for name in MARKERS[role]}
_MARKER = re.compile(r"^\s{0,3}(?:#{1,4} ?|\*{2}|\[|<\|?)?([A-Za-z][A-Za-z ]{0,19}?)(?:\|?>|\]:?|:\*{2}|\*{2}:|:)\s?")
#: Number of values of each feature: marker kind, length class, start, end.
SIZES = (len(ROLES) + 2, 6, 4, 4)
STATES = 2 * len(ROLES)  # 2 * role begins a turn, 2 * role + 1 continues it


def line_features(line: str) -> tuple[int, int, int, int]:
    found = _MARKER.match(line)
    kind = 0 if not found else _KIND.get(found[1].strip().lower(), len(ROLES) + 1)
    n = len(line) - (found.end() if found else 0)
    size = 0 if n == 0 else 1 if n < 40 else 2 if n < 120 else 3 if n < 300 else 4 if n < 900 else 5
    first, last = line[:1], line[-1:]
    start = 0 if not first or first.isspace() else 1 if first.isupper() else 2 if first.isalpha() else 3
    end = 0 if not last else 1 if last == "?" else 2 if last in ".!" else 3
    return kind, size, start, end


def strip_marker(line: str) -> str:
    """The line without a known speaker's marker."""
    found = _MARKER.match(line)
    return line[found.end():] if found and found[1].strip().lower() in _KIND else line


@dataclass
class Model:
    """Log probabilities: first state, next state by state, and feature values by state."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def emission(self, lines: list[str]) -> np.ndarray:
        codes = np.array([line_features(x) for x in lines]).reshape(-1, len(SIZES))
        return sum(table[:, codes[:, f]].T for f, table in enumerate(self.emit))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]) -> Model:
        begins = np.arange(STATES) % 2 == 0
        first = np.where(begins, np.log((start + 1) / (start + 1)[begins].sum()), -np.inf)
        allowed = begins[None, :] | (np.arange(STATES)[:, None] // 2 == np.arange(STATES)[None, :] // 2)
        share = (move + 1) * allowed
        with np.errstate(divide="ignore"):
            return cls(first, np.log(share / share.sum(1, keepdims=True)), [np.log((e + 0.5) / (e + 0.5).sum(1, keepdims=True)) for e in emit])


def segment_matrix(model: Model, emission: np.ndarray, first: bool) -> np.ndarray:
    """Best log probability from a state before the segment to a state at its last line; at a transcript's start every row is the same."""
    best = (np.tile(model.start, (STATES, 1)) if first else model.move) + emission[0]
    for row in emission[1:]:
        best = (best[:, :, None] + model.move[None]).max(1) + row
    return best


def combine(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None]).max(1)
    return out


def path_through(matrices: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """Best states at the ends of consecutive segments, from ``entry`` before the first to ``exit_`` after the last."""
    best, back = matrices[0][entry], []
    for m in matrices[1:]:
        step = best[:, None] + m
        back.append(step.argmax(0))
        best = step.max(0)
    states = [exit_]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def decode(model: Model, emission: np.ndarray, first: bool, entry: int, exit_: int) -> list[int]:
    """Best states of a segment's lines between a given entry and exit state."""
    steps = [(np.tile(model.start, (STATES, 1)) if first else model.move) + emission[0], *(model.move + row for row in emission[1:])]
    return path_through(steps, entry, exit_)


def _grouped(key: str, body: Callable[[dict], Iterator[tuple]], schema: T.StructType) -> Callable:
    """mapInArrow function over rows sorted so that equal ``key`` structs lie together; calls ``body`` with columns as lists."""
    arrow = [pa.int64() if isinstance(f.dataType, (T.LongType, T.IntegerType)) else pa.list_(pa.float64()) if isinstance(f.dataType, T.ArrayType) else pa.string() for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, done = None, None, []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names=schema.names)

        for batch in batches:
            columns = batch.to_pydict()
            keys = columns.pop(key)
            for i, k in enumerate(keys):
                if held is not None and k != last:
                    done += body(held)
                    held = None
                if held is None:
                    held, last = {c: [] for c in columns}, k
                for c, values in columns.items():
                    held[c].append(values[i])
            if len(done) >= 1000:
                yield flush(done)
                done = []
        if held is not None:
            done += body(held)
        if done:
            yield flush(done)

    return run


def _dealt(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    out = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return out.select(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys]).alias("_key"), "*")


def segments(chunks: DataFrame, id_col: str, order_col: str, text_col: str, segment_rows: int, role: Column | None = None) -> DataFrame:
    """(id, segment, position, text[, role]); segment 0 holds null positions, later ones ``segment_rows`` positions each."""
    position = F.col(order_col).cast("long")
    extra = [] if role is None else [role.alias("role")]
    return chunks.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.floor(position / segment_rows) + 1, F.lit(-(1 << 40))).alias("segment"),
                         position.alias("position"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *extra)


def train(chunks: DataFrame, *, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", role_col: str = "role", segment_rows: int = 256) -> Model:
    """Model from all labelled chunks, one turn each. Pairs of lines on both sides of a segment border are not counted as moves."""
    known = chunks.where(F.col(role_col).isin(*ROLES))
    rows = segments(known, id_col, order_col, text_col, segment_rows, F.col(role_col))
    rows = rows.withColumn("is_first", F.col("segment") <= 1)
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("table", "a", "b", "n")])
    sizes = [STATES, STATES * STATES, *[STATES * s for s in SIZES]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(s, np.int64) for s in sizes]
        last_key, last_state = None, 0
        for batch in batches:
            c = batch.to_pydict()
            for key, first, text, role in zip(c["_key"], c["is_first"], c["text"], c["role"]):
                for k, line in enumerate(text.split("\n")):
                    state = 2 * ROLES.index(role) + (k > 0)
                    if key == last_key:
                        tables[1][last_state * STATES + state] += 1
                    elif first:
                        tables[0][state] += 1
                    last_key, last_state = key, state
                    for f, value in enumerate(line_features(line)):
                        tables[2 + f][state * SIZES[f] + value] += 1
        found = [(t, 0, int(i), int(table[i])) for t, table in enumerate(tables) for i in np.flatnonzero(table)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=out.names)

    counted = _dealt(rows, ["id", "segment"], ["position", "text"]).mapInArrow(count, out).groupBy("table", "b").agg(F.sum("n").alias("n")).collect()
    tables = [np.zeros(s) for s in sizes]
    for r in counted:
        tables[r["table"]][r["b"]] = r["n"]
    return Model.from_counts(tables[0], tables[1].reshape(STATES, STATES), [t.reshape(STATES, s) for t, s in zip(tables[2:], SIZES)])


def parse(chunks: DataFrame, model: Model, *, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text",
          segment_rows: int = 256, fan_in: int = 256) -> DataFrame:
    """One row per recovered turn: the id (as ``id_col``), turn (from 0), role, n_lines, text, and the canonical rendering."""
    id_type = chunks.schema[id_col].dataType
    rows = segments(chunks, id_col, order_col, text_col, segment_rows)
    # segments without rows must not count: number the existing ones of each transcript
    numbered = (rows.select("id", "segment").distinct()
                .withColumn("s", (F.row_number().over(Window.partitionBy("id").orderBy("segment")) - 1).cast("long")))
    numbered = written(numbered, "chat-segments")
    rows = written(rows.withColumn("id", F.coalesce("id", F.lit("\0"))).join(
        numbered.withColumn("id", F.coalesce("id", F.lit("\0"))), ["id", "segment"]), "chat-rows")
    matrix = T.StructType([T.StructField("id", T.StringType()), T.StructField("s", T.LongType()), T.StructField("m", T.ArrayType(T.DoubleType()))])

    def up(held: dict) -> Iterator[tuple]:
        lines = "\n".join(held["text"]).split("\n")
        yield held["id"][0], held["s"][0], segment_matrix(model, model.emission(lines), held["s"][0] == 0).ravel().tolist()

    levels = [written(_dealt(rows, ["id", "s"], ["position", "text"]).mapInArrow(_grouped("_key", up, matrix), matrix), "chat-level")]
    most = levels[0].agg(F.max("s")).first()[0] or 0

    def higher(held: dict) -> Iterator[tuple]:
        yield held["id"][0], held["s"][0] // fan_in, combine([np.reshape(m, (STATES, STATES)) for m in held["m"]]).ravel().tolist()

    while most > 0:
        parent = _dealt(levels[-1].withColumn("p", F.expr(f"s div {fan_in}")), ["id", "p"], ["s"])
        levels.append(written(parent.mapInArrow(_grouped("_key", higher, matrix), matrix), "chat-level"))
        most //= fan_in
    ends = T.StructType([T.StructField("id", T.StringType()), T.StructField("s", T.LongType()), T.StructField("entry", T.LongType()), T.StructField("exit", T.LongType())])

    def top(held: dict) -> Iterator[tuple]:
        for i, s, m in zip(held["id"], held["s"], held["m"]):
            yield i, s, 0, int(np.reshape(m, (STATES, STATES))[0].argmax())

    bounds = _dealt(levels[-1], ["id"], ["s"]).mapInArrow(_grouped("_key", top, ends), ends)

    def lower(held: dict) -> Iterator[tuple]:
        states = path_through([np.reshape(m, (STATES, STATES)) for m in held["m"]], held["entry"][0], held["exit"][0])
        yield from zip(held["id"], held["s"], [held["entry"][0], *states[:-1]], states)

    for level in reversed(levels[:-1]):
        of = bounds.withColumnRenamed("s", "p")
        both = level.withColumn("p", F.expr(f"s div {fan_in}")).join(of, ["id", "p"])
        bounds = written(_dealt(both, ["id", "p"], ["s"]).mapInArrow(_grouped("_key", lower, ends), ends), "chat-bounds")
    part = T.StructType([T.StructField("id", T.StringType()), T.StructField("s", T.LongType()), T.StructField("k", T.LongType()),
                         T.StructField("role", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("text", T.StringType())])

    def turns(held: dict) -> Iterator[tuple]:
        lines = "\n".join(held["text"]).split("\n")
        states = decode(model, model.emission(lines), held["s"][0] == 0, held["entry"][0], held["exit"][0])
        k, own = 0, []
        for line, state in zip(lines, states):
            if state % 2 == 0:
                if own:
                    yield held["id"][0], held["s"][0], k, role, len(own), "\n".join(own)
                k, own = k + 1, [strip_marker(line)]
            else:
                own.append(line)
            role = ROLES[state // 2]
        yield held["id"][0], held["s"][0], k, role, len(own), "\n".join(own)

    parts = written(_dealt(rows.join(bounds, ["id", "s"]), ["id", "s"], ["position", "text"]).mapInArrow(_grouped("_key", turns, part), part), "chat-parts")
    # part k of a segment is turn k - 1 of those that begin there; part 0 continues the turn before
    begun = parts.groupBy("id", "s").agg(F.max("k").alias("begun"))
    before = F.coalesce(F.sum("begun").over(Window.partitionBy("id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.join(begun.select("id", "s", before.alias("before")), ["id", "s"]).withColumn("turn", F.col("before") + F.col("k") - 1)
    piece = F.sort_array(F.collect_list(F.struct("s", "text")))
    whole = placed.groupBy("id", "turn").agg(F.min("role").alias("role"), F.sum("n_lines").alias("n_lines"), F.array_join(F.transform(piece, lambda x: x["text"]), "\n").alias("text"))
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    return whole.select(F.nullif("id", F.lit("\0")).cast(id_type).alias(id_col), "turn", "role", "n_lines", "text", rendered.alias("rendered"))


#: Ways in which transcripts mark the system, user and assistant speaker.
STYLES = (("System: ", "User: ", "Assistant: "), ("Context: ", "Human: ", "AI: "), ("### System: ", "### Instruction: ", "### Response: "),
          ("**System prompt:** ", "**Question:** ", "**Answer:** "), ("<|system|>", "<|user|>", "<|assistant|>"))


def as_transcript(conversations: DataFrame, *, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", role_col: str = "role", unmarked_percent: int = 15) -> DataFrame:
    """Chunks of raw transcripts: each conversation in one marker style, a share of the turns (by hash) without a marker."""
    style = F.pmod(F.xxhash64(id_col, F.lit("style")), F.lit(len(STYLES)))
    marker = F.coalesce(*[F.when((style == s) & (F.col(role_col) == r), STYLES[s][i]) for s in range(len(STYLES)) for i, r in enumerate(ROLES)], F.lit(""))
    marked = (F.pmod(F.xxhash64(id_col, order_col, F.lit("mark")), F.lit(100)) >= unmarked_percent) | F.col(order_col).isNull()
    return conversations.withColumn(text_col, F.concat(F.when(marked, marker).otherwise(""), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
