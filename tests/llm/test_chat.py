"""Transcript parsing: segmented Viterbi equals the plain one; held-out accuracy; odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from trialstats.llm import chat
from trialstats.llm.chat import ROLES, STATES, Model, as_transcript, line_features, parse, strip_marker, train


def _random_model(seed):
    rng = np.random.default_rng(seed)
    return Model.from_counts(rng.integers(0, 20, STATES), rng.integers(0, 20, (STATES, STATES)), [rng.integers(0, 20, (STATES, s)) for s in chat.SIZES])


def _viterbi(model, lines):
    e = model.emission(lines)
    best, back = model.start + e[0], []
    for row in e[1:]:
        step = best[:, None] + model.move
        back.append(step.argmax(0))
        best = step.max(0) + row
    path, score = [int(best.argmax())], best.max()
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], score


def _turns(model, lines):
    out = []
    for line, s in zip(lines, _viterbi(model, lines)[0]):
        if s % 2 == 0:
            out.append([ROLES[s // 2], strip_marker(line)])
        else:
            out[-1][1] += "\n" + line
    return [tuple(t) for t in out]


def test_features_and_markers():
    assert line_features("User: hello?") == (2, 1, 1, 1) and line_features("") == (0, 0, 0, 0)
    assert line_features("### Response: done.")[0] == 3 and line_features("<|system|>x")[0] == 1 and line_features("Bob: hi")[0] == len(ROLES) + 1
    assert strip_marker("**Question:** why") == "why" and strip_marker("Bob: hi") == "Bob: hi" and strip_marker("plain") == "plain"


def test_segments_equal_the_whole(spark):
    """One long transcript over several levels of segments, others short, against plain Viterbi."""
    rnd = random.Random(7)
    rows = [(c, t, rnd.choice(["User: ", "AI: ", "", "", "System: "]) + "\n".join("w " * rnd.randrange(0, 40) + rnd.choice(["?", ".", ""]) for _ in range(rnd.randrange(1, 4))))
            for c, n in ((1, 90), (2, 3), (None, 4), (3, 1)) for t in range(n)]
    model = _random_model(1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = defaultdict(list)
    for r in sorted(parse(df, model, segment_rows=4, fan_in=3).collect(), key=lambda r: r["turn"]):
        got[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
        assert r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>\n" and r["n_lines"] == r["text"].count("\n") + 1
    for c in (1, 2, None, 3):
        lines = "\n".join(t for i, _, t in rows if i == c).split("\n")
        want = _turns(model, lines)
        assert [g[0] for g in got[c]] == list(range(len(want))) and [g[1:] for g in got[c]] == want


def test_held_out_roles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    chunks = as_transcript(rows)
    learn = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 3 != 1
    found = defaultdict(list)
    for r in sorted(parse(chunks.drop("role"), train(chunks.where(learn))).collect(), key=lambda r: r["turn"]):
        found[r["conv_id"]] += [r["role"]] * r["n_lines"]
    right = total = 0
    want = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r["turn"]):
        want[r["conv_id"]] += [r["role"]] * (r["text"].count("\n") + 1)
    for c, roles in want.items():
        if zlib.crc32(str(c).encode()) % 3 == 1:
            assert len(found[c]) == len(roles)
            right, total = right + sum(a == b for a, b in zip(found[c], roles)), total + len(roles)
    assert total > 300 and right > 0.93 * total


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, id long"
    rows = [(1, 0, "user", None, 9), (1, 0, "user", None, 9), (1, None, None, "x", 9), (None, 1, "tool", "", 9), (2, 5, "user", "a\n" * 3000, 9)]
    df = spark.createDataFrame(rows, schema)
    model = train(df)
    out = parse(as_transcript(df), model).collect()
    lines = defaultdict(int)
    for r in out:
        lines[r["conv_id"]] += r["n_lines"]
    assert lines == {1: 3, None: 1, 2: 3001}
    empty = spark.createDataFrame([], schema)
    assert parse(as_transcript(empty), train(empty)).collect() == []
