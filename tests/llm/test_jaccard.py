"""N-gram Jaccard join against brute force; groups that need every step of the search."""

import random

import numpy as np
import pyarrow as pa
import pytest

from llm_tables import no_docs, odd_docs  # noqa: F401
from plain import jaccard_components, shingles
from trialstats.llm import jaccard
from trialstats.llm.components import components
from trialstats.llm.shared import shipped
from trialstats.llm.words import WordHasher


def _rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=lambda r: (r[0] is None, r))


def _want(rows):
    return sorted(jaccard_components(rows), key=lambda r: (r[0] is None, r))


def _near_copies(seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, n = [], 0
    for size in (1, 2, 3, 4, 5, 6, 8, 12, 20, 30, 60, 120, 300):
        for _ in range(3):
            base = [rnd.choice(vocabulary) for _ in range(size)]
            for _ in range(12):
                copy = list(base)
                for _ in range(rnd.randrange(0, 1 + max(1, size // 25))):
                    copy[rnd.randrange(size)] = rnd.choice(vocabulary)
                if rnd.random() < 0.3:
                    copy = copy[:max(1, int(size * rnd.uniform(0.7, 1)))]
                rows.append((n, " ".join(copy)))
                n += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("light", [None, 0, 40])
def test_equals_brute_force(spark, monkeypatch, light):
    if light is not None:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda *a: light)
    rows = _near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(jaccard.jaccard_components(df)) == _want(rows)


@pytest.mark.parametrize("part", [1_000, 7])
def test_hot_lists_and_open_lists(spark, monkeypatch, part):
    """Many heavily changed copies of one text in few tasks: hot lists, open lists (also of many parts), and the test of what is left."""
    for name, value in (("FEW_LISTS", 1), ("FEW_IN_LIST", 1), ("FEW_OF_SET", 1), ("LIST_PART", part), ("LIST_ROWS", 30), ("PAIRS_HELD", 50)):
        monkeypatch.setattr(jaccard, name, value)
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rnd.randrange(0, 4)):
            copy[rnd.randrange(80)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert _rows(jaccard.jaccard_components(df)) == _want(rows)


@pytest.mark.parametrize("part", [1_000, 5])
def test_every_link_is_counted(spark, monkeypatch, odd_docs, no_docs, part):
    """Also inside groups of near copies, of equal texts, and in lists of several parts."""
    monkeypatch.setattr(jaccard, "LIST_PART", part)
    rows = _near_copies()[:250]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), odd_docs):
        sets = [(r["doc_id"], shingles(r["text"])) for r in df.collect()]
        want = [(d, len(x), sum(j != i and bool(x) and 175 * len(x & y) >= 75 * (len(x) + len(y)) for j, (_, y) in enumerate(sets))) for i, (d, x) in enumerate(sets)]
        got = [(r["doc_id"], r["n_shingles"], r["n_links"]) for r in jaccard.link_counts(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and max(w[2] for w in want) > 1
    assert jaccard.link_counts(no_docs).collect() == []


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert _rows(jaccard.jaccard_components(odd_docs)) == _want(rows)
    assert jaccard.jaccard_components(no_docs).collect() == []


def test_one_of_each_group(spark, odd_docs, no_docs):
    kept = jaccard.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    got = sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in kept.collect()), key=str)
    want = [(1, "a b c d e"), (2, ""), (3, ""), (4, " \n\t "), (5, "w0x0 w1x1"), (6, "one two"), (8, ""), (None, ""), (9, "über stra")]
    assert got == sorted(want, key=str)
    assert jaccard.one_of_each_group(no_docs).collect() == []


def test_texts_of_groups_are_hashed_once_a_branch(spark, odd_docs):
    """Joins and filters on the set id do not run its function a second time, in further Python workers of the same task."""
    plan = jaccard.one_of_each_group(odd_docs)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 3


def test_working_columns_do_not_clash(spark):
    rows = [(1, "a b c d e f g", 10, 20, 30), (2, "a b c d e f g", 11, 21, 31), (3, None, 12, 22, 32)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _llm_set long, _llm_stay_set long, _LLM_stay_id long")
    got = jaccard.one_of_each_group(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_prefixes_lose_no_pair():
    """Any two sets at the threshold share a key of their prefixes, light or heavy, within the bounds."""
    rng = np.random.default_rng(0)
    sketch = rng.integers(0, 3, 1 << jaccard.ORDER_BITS).astype(np.uint8)
    for light in (0, 30):
        rule = jaccard.Rule(75, light)
        for _ in range(150):
            shared = int(rng.integers(2, 70))
            both = rng.integers(0, 1 << 63, shared).astype(np.uint64)
            extra = [rng.integers(0, 1 << 63, int(k)).astype(np.uint64) for k in rng.integers(0, max(1, shared // 3) + 1, 2)]
            x, y = (np.unique(np.concatenate([both, e])) for e in extra)
            overlap = len(np.intersect1d(x, y))
            if 100 * overlap < 75 * (len(x) + len(y) - overlap) or len(x) < 2 or len(y) < 2 or len(x) == len(y) == overlap:
                continue
            found = []
            for s in (x, y):
                k, _, p = jaccard.postings(rule, sketch, s, np.array([0, len(s)]), np.array([len(s)]))
                found.append(dict(zip(k.tolist(), rule.largest_partner(np.full(len(p), len(s)), p).tolist())))
            assert any(len(y) <= found[0][k] and len(x) <= found[1][k] for k in found[0].keys() & found[1].keys())


def test_profiles_bound_the_overlap():
    rng = np.random.default_rng(2)
    excluded = 0
    for _ in range(200):
        both = rng.integers(0, 1 << 63, int(rng.integers(0, 900))).astype(np.uint64)
        x, y = (np.unique(np.concatenate([both[:int(rng.integers(0, len(both) + 1))], rng.integers(0, 1 << 63, int(rng.integers(1, 900))).astype(np.uint64)])) for _ in range(2))
        most = jaccard.largest_overlap(jaccard.profile(x), jaccard.profile(y))
        overlap = len(np.intersect1d(x, y))
        assert most >= overlap
        excluded += 175 * most < 75 * (len(x) + len(y))
    assert excluded > 100
    assert jaccard.profile(np.zeros(300, np.uint64)) is None and jaccard.largest_overlap(None, b"\1" * 8) is None


def test_admitted_pairs_are_all_that_bounds_admit(monkeypatch):
    """Against a loop over all pairs of a place, for whole lists and parts, known and unknown profiles."""
    monkeypatch.setattr(jaccard, "PAIRS_HELD", 20)
    rng = np.random.default_rng(4)
    rows, sets = [], {}
    for place in range(30):
        base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        two = int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 12))):
            own = np.unique(np.concatenate([base[rng.random(60) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 25))).astype(np.uint64)]))
            i = int(rng.integers(-(1 << 62), 1 << 62))
            sets[i] = own
            cells = None if rng.random() < 0.1 else np.frombuffer(jaccard.profile(own), np.uint8).tobytes()
            rows.append({"key": place, "lo": 0, "hi": two, "part": int(rng.integers(0, two + 1)), "id": i, "n": len(own), "most": int(rng.integers(60, 120)), "component": int(rng.integers(0, 4)), "cells": cells})
    table = pa.Table.from_pylist(rows)
    got = {(int(x), int(y)) for a, b in jaccard.admitted_pairs(table, 75, None) for x, y in zip(a, b)}
    want, linked = set(), set()
    for x in rows:
        for y in rows:
            if x["key"] == y["key"] and x["id"] < y["id"] and x["component"] != y["component"] and x["n"] <= y["most"] and y["n"] <= x["most"] and (x["hi"] == 0 or x["part"] != y["part"]):
                bound = jaccard.largest_overlap(*(None if z["cells"] is None else jaccard.profile(sets[z["id"]]) for z in (x, y)))
                if 175 * min(bound if bound is not None else 1 << 30, x["n"], y["n"]) >= 75 * (x["n"] + y["n"]):
                    want.add((x["id"], y["id"]))
                if 175 * len(np.intersect1d(sets[x["id"]], sets[y["id"]])) >= 75 * (x["n"] + y["n"]):
                    linked.add((x["id"], y["id"]))
    assert got == want and linked and linked < got
    few = [(int(x), int(y)) for a, b in jaccard.admitted_pairs(table, 75, 1) for x, y in zip(a, b)]
    assert set(few) < got and len(few) == len(set(few))


def test_boundary_follows_the_cost():
    assert jaccard.choose_boundary({}, 75) == 0
    assert jaccard.choose_boundary({10: 1000}, 75, scan_cost=100) >= 10
    assert jaccard.choose_boundary({60: 1000}, 75, scan_cost=0.01) < 60


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)] + [(200, k) for k in range(201, 230)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, **{i: 200 for i in range(200, 230)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_parities_bound_the_difference():
    """Also between sets of unlike sizes, whose parities are folded; pairs that share half of their shingles are excluded."""
    rng = np.random.default_rng(8)
    for n in (1, 40, 500, 3000):
        for share in (0.0, 0.5, 0.8, 1.0):
            both = rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64)
            x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, int(m * (1 - share))).astype(np.uint64)])) for m in (n, n * 5 // 4))
            apart = jaccard.least_difference(jaccard.parities(x), jaccard.parities(y))
            assert apart <= len(np.setxor1d(x, y))
            assert share > 0.5 or n == 1 or 175 * (len(x) + len(y) - apart) < 150 * (len(x) + len(y))


def test_open_lists_of_unlike_sets_admit_few_pairs():
    """Sets of 500 shingles that share two thirds of them: the counts in 64 cells admit their pairs, the parities none."""
    rng = np.random.default_rng(9)
    base, rows = rng.integers(0, 1 << 63, 500).astype(np.uint64), []
    for i in range(60):
        own = np.unique(np.concatenate([base[rng.random(500) < 0.67], rng.integers(0, 1 << 63, 165).astype(np.uint64)]))
        rows.append({"key": 1, "lo": 0, "hi": 0, "part": 0, "id": i, "n": len(own), "most": 1000, "component": i,
                     "cells": np.frombuffer(jaccard.profile(own), np.uint8).reshape(-1, jaccard.CELLS).sum(0).astype(np.uint8).tobytes(),
                     "odd": jaccard.folded(jaccard.parities(own), jaccard.PARITY_BYTES).tobytes()})
    table = pa.Table.from_pylist(rows)
    assert sum(len(a) for a, _ in jaccard.admitted_pairs(table.drop_columns(["odd"]), 75, None)) > 500
    assert sum(len(a) for a, _ in jaccard.admitted_pairs(table, 75, None)) == 0


def test_bit_array_grows_with_its_values(spark):
    """Values that are not among 400,000 are excluded as often as with few; an array of fixed size let a sixth of them through."""
    values = spark.range(400_000).selectExpr("xxhash64(id) as value")
    bits = jaccard.bit_array(values, "value", 400_000)
    own = values.toArrow().column("value").to_numpy().view(np.uint64)
    others = np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert jaccard.may_hold(bits, own).all() and jaccard.may_hold(bits, others).mean() < 0.1


@pytest.mark.parametrize("most_bits", [1 << 12, 1 << 26])
def test_entries_are_those_of_open_lists(spark, monkeypatch, most_bits):
    """Also where the bit array excludes next to nothing, with several blocks a task; equal texts give one entry."""
    monkeypatch.setattr(jaccard, "BIT_ARRAY_BITS", most_bits)
    monkeypatch.setattr(jaccard, "POSTING_BLOCK", 500)
    rows = _near_copies()[:300]
    rows += [(1000 + i, t) for i, t in rows[:20]] + [(2000, None), (2001, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rule, order, want = jaccard.Rule(75, 14), np.zeros(1 << jaccard.ORDER_BITS, np.uint8), set()
    for _, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        values, bounds, n, ids = jaccard.document_sets(WordHasher(), data, np.array([0, len(data)]))
        key, _, position = jaccard.postings(rule, order, values, bounds, n)
        want |= {(int(k), int(ids[0]), int(n[0])) for k in key}
    keys = sorted({k for k, _, _ in want})[::3]
    open_keys = spark.createDataFrame([(k,) for k in keys], "key long").repartition(2)
    got = [(r["key"], r["id"], r["n"]) for r in jaccard._open_entries(texts, rule, shipped(spark, order), open_keys, 8).collect()]
    assert sorted(got) == sorted(w for w in want if w[0] in set(keys)) and len(got) > 300
