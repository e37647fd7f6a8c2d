"""Long repeats: suffix arrays and the removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_tables import no_docs, odd_docs  # noqa: F401
from trialstats.llm.suffix import neighbour_prefixes, suffix_array, without_repeats


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        reach = 0
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                for k in range(max(i, reach), i + length):
                    gone[k] = True
                reach = i + length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def rows_of(df):
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=60), min_size=1, max_size=6), st.integers(2, 40))
def test_suffix_array_and_prefixes(parts, depth):
    raw = [p.encode() for p in parts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    room = np.concatenate([np.arange(len(p), 0, -1) for p in raw])
    piece = [(p, i) for p in raw for i in range(len(p))]
    sa = suffix_array(data, room, depth)
    assert sorted(sa.tolist()) == list(range(len(data)))
    owned = room >= depth
    heads = [piece[i][0][piece[i][1]:][:depth] for i in sa if owned[i]]
    assert heads == sorted(heads)
    at, to, common = neighbour_prefixes(data, room, sa, owned, depth)
    order = [i for i in sa if owned[i]]
    assert sorted(zip(order[1:], order[:-1])) == list(zip(at.tolist(), to.tolist()))
    for i, j, n in zip(at, to, common):
        a, b = (p[k:] for p, k in (piece[i], piece[j]))
        assert n == min(depth, next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))))


def _texts(rnd, n):
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 30))) for _ in range(4)]
    out = []
    for _ in range(n):
        kind = rnd.random()
        own = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))]
        if kind < 0.6:
            own.insert(rnd.randint(0, 1), rnd.choice(passages))
        if kind < 0.2 and out:
            old = rnd.choice(out).split(" ")
            old[rnd.randrange(len(old))] = "zz"
            own = [" ".join(old)]
        if kind > 0.95:
            own = ["ab" * rnd.randint(0, 300)]
        if 0.9 < kind < 0.95:
            own = [rnd.choice(words) + " " + "abc d" * rnd.randint(8, 20)]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("shard_bytes", [300, 1 << 19])  # 300: owners are salted over shards that are merged
def test_removal_equals_brute_force(spark, shard_bytes):
    rnd = random.Random(shard_bytes)
    texts = _texts(rnd, 150)
    texts += [texts[3]] * 3 + [None, "", texts[5]]
    want = sorted(((i, *w) for i, w in enumerate(brute(texts, 40))), key=str)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert rows_of(without_repeats(docs, length=40, shard_bytes=shard_bytes)) == want
    assert sum(w[2] for w in want) and sum(not w[2] for w in want)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    local = [tuple(r) for r in docs.collect()]
    want = sorted(((d, *w) for (d, _), w in zip(local, brute([t for _, t in local], 400))), key=str)
    assert rows_of(without_repeats(docs)) == want and sum(w[2] for w in want)


def test_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.selectExpr("*", "1 AS key", "2 AS owner", "'x' AS windows", "4 AS id")
    local = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for length in (4, 400):
        want = sorted(((d, *w) for (d, _), w in zip(local, brute([t for _, t in local], length))), key=str)
        assert rows_of(without_repeats(clash, length=length)) == want
    assert without_repeats(no_docs).collect() == []
    long = spark.createDataFrame([(1, "ab " * 500_000 + "end"), (2, "x" + "ab " * 300 + "y")], "doc_id long, text string")  # more than a block of anchors
    got = {r[0]: r for r in rows_of(without_repeats(long))}
    assert got[1][2:4] == (1_500_000, 1) or got[1][2:4] == (1_500_001, 1)
    assert got[2][2:4] == (900, 1)
