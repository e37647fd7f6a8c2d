"""Language-model scores: exact base scores, the filter's guarantees, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_tables import docs, no_docs, odd_docs  # noqa: F401
from plain import words
from trialstats.llm import lm
from trialstats.llm.lm import Filter, Scale, _cutoffs, fill_words, score


def _held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


def _want(rows):
    tokens = [(d, [*words(t), None]) for d, t in rows]
    c = Counter(w for d, ws in tokens if not _held_out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((d, _held_out(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in tokens), key=str)


def _got(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot_share", [100_000, 50])
def test_base_scores(spark, docs, monkeypatch, hot_share):
    """Also with small blocks, so that texts of one task lie in several of them."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _got(score(docs, hot_share=hot_share)) == _want(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    assert _got(score(odd_docs)) == _want([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert score(no_docs).collect() == []
    none = score(odd_docs, held_out=F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in none)


def test_filter_never_misses_and_seldom_adds():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 48, 200_000).astype(np.uint64))
    scale = Scale()
    counts = 2 + rng.geometric(0.3, len(keys))
    level = np.searchsorted(scale.ends(2), counts, "right")
    size = -(-int(level.sum()) * 12 // 64)
    f = Filter.of(Filter({1: fill_words(keys, level, size, 5)}, {1: np.array([0, size])}, {1: 2}, 5, scale, 0.3).parts())
    assert (f.levels(1, keys) >= level).all()
    low, high = f.bounds(1, level)
    assert (low <= counts).all() and (counts <= high).all()
    absent = rng.integers(0, 1 << 48, 200_000).astype(np.uint64)
    assert (f.levels(1, absent) > 0).mean() < 0.02 and (f.levels(1, keys) > level).mean() < 0.02


def test_cutoffs_keep_to_the_bound():
    scale = Scale()
    ends = scale.ends(1)
    levels = {(1, 1): 1000, (1, 2): 500, (2, 2): 100_000, (2, 3): 1000, (2, 9): 10}
    assert _cutoffs(levels, ends, (1, 2), 12, 10**9, scale) == {1: 1, 2: 2}
    least = _cutoffs(levels, ends, (1, 2), 12, 60_000, scale)
    assert least[2] > 2 and least[1] == 1
    assert _cutoffs(levels, ends, (1, 2), 12, 0, scale)[1] > 2


def test_scores_beat_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.max("score")).first()
    assert got[0] > got[1] and got[2] < 0


def test_small_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    assert _got(score(docs)) == _want([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_the_filter_grows_with_the_input(spark, monkeypatch):
    """Far more distinct pairs than any fixed share of memory: every bucket holds all of its own, none is cut off."""
    monkeypatch.setattr(lm, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 700)
    texts = [f"a{i} b{i} a{i} b{i} a{i} b{i}" for i in range(3_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plain = {r["doc_id"]: r["score"] for r in score(rows, held_out=F.lit(False)).collect()}
    n, v = 7 * len(texts), 2 * len(texts) + 1
    # a b occurs three times (level 3), the other pairs twice or once
    share = 3 * len(texts) / n
    single = (3 + 1) / (n + v + 1)
    b_after_a = math.log10(share * 3 / 3 + (1 - share) * single)
    a_after_b = math.log10(share * 2 / 3 + (1 - share) * single)
    # the first word and the end token follow words whose pairs occur once
    ends = Scale().ends(1)
    low_end = int(ends[np.searchsorted(ends, len(texts), "right") - 1])
    first = math.log10((1 - share) * single)
    last = math.log10((1 - share) * (low_end + 1) / (n + v + 1))
    want = first + 3 * b_after_a + 2 * a_after_b + last
    near = [abs(s - want) < 0.02 for s in plain.values()]
    assert len(near) == len(texts) and sum(near) > 0.9 * len(texts)  # the rest: false probes


def test_nothing_of_the_filter_is_sent_to_the_driver():
    """No bound on the filter's bytes is left in the interface, and a bucket's filter holds every entry of its keys."""
    import inspect

    assert "filter_mb" not in inspect.signature(score).parameters
    keys = np.arange(1, 2_000_001, dtype=np.uint64) << np.uint64(20)
    f = lm.build_filter(2, keys, np.full(len(keys), 3, np.uint64), least=2)
    assert (f.levels(2, keys) >= 2).all() and f.least == {2: 2}
