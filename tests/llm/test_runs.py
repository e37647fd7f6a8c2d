"""Periodic runs: the grammar's runs against a scan over all periods."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_tables import no_docs, odd_docs  # noqa: F401
from plain import words
from trialstats.llm.runs import find_runs, merged, periodic_runs, planted, repair, run_digest

PLANT = "crc32(cast(cast(doc_id AS string) AS binary))"


def brute(w, least=12):
    """(start, end, period) of all runs, by start and period."""
    found, w = {}, np.unique(np.array(w), return_inverse=True)[1] if len(w) else np.zeros(0, int)
    for p in range(1, len(w) // 2 + 1):
        same = np.concatenate([[0], w[:-p] == w[p:], [0]]).astype(int)
        step = np.diff(same)
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if b + p - a >= max(least, 2 * p):
                found.setdefault((a, b + p), p)
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def digest(doc_id, text, plant=True):
    w = [x.encode() for x in words(text, lower=False)]
    if plant and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute(w)
    gone = {i for a, b, p in runs for i in range(a + p, b)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{a},{b - a},{p}\n" for a, b, p in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else [None] * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@st.composite
def repetitive(draw):
    letters = draw(st.sampled_from([1, 2, 3, 40]))
    out = []
    for _ in range(draw(st.integers(0, 7))):
        block = draw(st.lists(st.integers(0, letters - 1), min_size=1, max_size=9))
        out += block * draw(st.integers(1, 6)) + block[:draw(st.integers(0, 9))]
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(repetitive(), max_size=4), st.sampled_from([4, 7, 12]))
def test_runs_equal_brute_force(texts, least):
    ids = np.array([x for w in texts for x in w], np.int64)
    got = find_runs(ids, np.repeat(np.arange(len(texts)), [len(w) for w in texts]), least).tolist()
    want, at = [], 0
    for w in texts:
        want += [[a + at, b + at, p] for a, b, p in brute(w, least)]
        at += len(w)
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(repetitive().filter(len), min_size=1, max_size=3))
def test_grammar_derives_the_text(texts):
    """A rule's occurrences are equal texts, and the last nonterminal of a stretch is the whole of it."""
    ids = np.array([x for w in texts for x in w], np.int64)
    whole = {}
    for kind, pos, left, size in repair(ids, np.repeat(np.arange(len(texts)), [len(w) for w in texts])):
        same = {}
        for k, p, a, n in zip(kind.tolist(), pos.tolist(), left.tolist(), size.tolist()):
            assert 0 < a < n and same.setdefault(k, (a, ids[p:p + n].tolist())) == (a, ids[p:p + n].tolist())
            whole[p] = max(whole.get(p, 1), n)
    at = 0
    for w in texts:
        assert whole.get(at, 1) == len(w)
        at += len(w)


def test_merging():
    rows = np.array([(0, 20, 4), (8, 30, 4), (0, 30, 8), (28, 44, 4), (50, 70, 2), (50, 70, 4)])
    assert merged(rows).tolist() == [[0, 30, 4], [28, 44, 4], [50, 70, 2]]


def test_long_texts():
    rnd = random.Random(3)
    block = [rnd.randrange(5000) for _ in range(7001)]
    ids = np.array([1] * 50_000 + block * 5 + [2, 3] * 9000)
    assert find_runs(ids, np.zeros(len(ids), np.int64)).tolist() == [[0, 50_000, 1], [50_000, 50_000 + 7001 * 5, 7001], [85_005, 103_005, 2]]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((digest(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    got = _rows(run_digest(periodic_runs(docs, plant_key=PLANT)))
    assert got == want and sum(r[1] for r in got) > 10
    plain = _rows(run_digest(periodic_runs(docs)))
    assert plain == sorted((digest(r["doc_id"], r["text"], plant=False) for r in docs.collect()), key=str)


def test_odd_rows(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(10, "x " * 800, 0), (11, "a b\x0b" * 20 + " c", 0), (0, "one two three " * 30, 0), (None, "q " * 30, 0)], odd_docs.schema)
    both = odd_docs.unionAll(extra).selectExpr("*", "1 AS id", "2 AS key", "'z' AS runs")
    short = both.where("doc_id IS NULL OR doc_id <> 5")  # the long text has a known period
    assert _rows(run_digest(periodic_runs(short, plant_key=PLANT))) == sorted((digest(r["doc_id"], r["text"]) for r in short.collect()), key=str)
    long = run_digest(periodic_runs(both.where("doc_id = 5"))).first()
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 60_000, 997 * 13)
    assert periodic_runs(no_docs).collect() == []
    assert planted([], 10) == [] and planted([b"a", b"b", b"c", b"d"], 10) == [b"a", b"b", b"b", b"b"] and planted([b"a", b"b"], 11) == [b"a", b"b"]
    found = periodic_runs(extra).collect()
    assert found[0]["runs"][0].asDict() == {"start": 0, "length": 800, "period": 1} and found[0]["collapsed"] == b"x"
