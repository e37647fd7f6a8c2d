"""Sharding: the smallest capacity by brute force, whole groups, gapless slots."""

import random
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from llm_tables import no_docs, odd_docs  # noqa: F401
from trialstats.llm import sharding
from trialstats.llm.sharding import greedy_cuts, minimax_cut_keys, shard_documents, smallest_capacity


def _best(sizes, shards):
    """Smallest largest shard of a contiguous partition, by dynamic programming."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    best = total[:]
    for _ in range(shards - 1):
        best = [min(max(best[j], total[i] - total[j]) for j in range(i + 1)) for i in range(len(total))]
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=25), st.integers(1, 6))
def test_smallest_capacity(sizes, shards):
    c = smallest_capacity(sizes, shards)
    assert c == _best(sizes, shards)
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    assert len(greedy_cuts(total, c)) < shards


def test_refined_cuts_equal_those_on_all_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEVEL_BITS", 4)  # many levels of refinement
    rnd = random.Random(4)
    for trial in range(4):
        keys = sorted({rnd.randrange(-(1 << 63), 1 << 63) if trial % 2 else rnd.randrange(-1000, 1000) for _ in range(300)})
        sizes = [rnd.choice([1, 2, 3, 50, 400]) for _ in keys]
        groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long").cache()
        cuts, capacity = minimax_cut_keys(groups, 6)
        assert capacity == _best(sizes, 6)
        shard = [sum(k >= c for c in cuts) for k in keys]
        per = defaultdict(int)
        for s, z in zip(shard, sizes):
            per[s] += z
        assert max(per.values()) == capacity


def _check(rows, out, shards=16):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == sorted(
        ((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows), key=str)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in out:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return groups


def test_documents(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = shard_documents(docs, rows_per_bin=10).collect()
    assert all(len(s) == 1 for s in _check(docs.collect(), out).values())
    size = defaultdict(int)
    for r in out:
        size[r["shard"]] += r["size"]
    assert len(size) == 16 and max(size.values()) < 1.1 * sum(size.values()) / 16
    _check(odd_docs.collect(), shard_documents(odd_docs).collect())
    assert shard_documents(no_docs).collect() == []


def test_a_hot_group_leaves_no_shard_empty(spark):
    rows = [(i, "hot " * 50) for i in range(300)] + [(1000 + i, f"text {i} " * 10) for i in range(300)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    per = defaultdict(int)
    for r in out:
        per[r["shard"]] += r["size"]
    assert len(per) == 16 and len({r["shard"] for r in out if r["doc_id"] < 300}) == 1
    rest = sorted(per.values())[:-1]
    assert max(rest) < 1.15 * sum(rest) / 15
