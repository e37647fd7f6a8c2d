"""Quality rules: counts against brute force, monotone trees, held-out accuracy."""

import numpy as np
import pytest

from llm_tables import docs, no_docs, odd_docs  # noqa: F401
from plain import dup_lines, repeat_words, words
from trialstats.llm.quality import FEATURES, Trees, judge_quality, keep_good, train_on_labels, train_trees


def _counts(text):
    w, t = words(text, lower=False), text or ""
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup_lines(text), repeat_words(w)


def _check(rows, out):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in out), key=str) == sorted(((r["doc_id"], *_counts(r["text"])) for r in rows), key=str)
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_counts(spark, docs, odd_docs, no_docs):
    _check(docs.collect(), judge_quality(docs, None).collect())
    _check(odd_docs.collect(), judge_quality(odd_docs, None).collect())
    lines = spark.createDataFrame([(1, "a\nb\na\n\n \na \r\na"), (2, "\n\nx\nx"), (3, "a b c a b c a b"), (4, "a a a a")], "doc_id long, text string")
    _check(lines.collect(), judge_quality(lines, None).collect())
    assert judge_quality(no_docs, None).collect() == [] and keep_good(no_docs, None).collect() == []


def test_kept_rows_are_those_judged(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    trees = train_on_labels(docs, labels)
    kept = {r["doc_id"] for r in judge_quality(docs, trees).where("kept").collect()}
    got = keep_good(docs, trees)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == kept and 0 < len(kept) < docs.count()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trees = train_on_labels(docs, labels.where("doc_id % 3 <> 0"))
    both = judge_quality(docs, trees).where("not base_failed").join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert len(both) > 80 and np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in both]) > 0.95


def test_no_usable_labels(spark, docs):
    schema = "doc_id long, quality int"
    for rows in ([], [(None, 1), (0, None)], [(0, 1), (1, 1)]):
        assert train_on_labels(docs, spark.createDataFrame(rows, schema)) is None


def _walk(trees, row):
    total = trees.start
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if row[f[node]] > t[node] else 1)
        total += leaf[node - len(f)]
    return total


def test_flat_arrays_and_monotone_features():
    rng = np.random.default_rng(3)
    x = rng.random((1500, 4))
    y = ((x[:, 0] + np.sin(6 * x[:, 1]) + 0.3 * rng.normal(size=1500)) > 0.7).astype(float)
    trees = train_trees(x, y, [1, 0, -1, 0], trees=40)
    assert isinstance(trees, Trees)
    assert np.allclose([_walk(trees, r) for r in x[:50]], trees.margin(x[:50]))
    assert ((trees.probability(x) >= 0.5) == y).mean() > 0.85
    for j, sign in ((0, 1), (2, -1)):
        line = np.repeat(x[:40], 30, axis=0)
        line[:, j] = np.tile(np.linspace(0, 1, 30), 40)
        steps = np.diff(trees.margin(line).reshape(40, 30), axis=1) * sign
        assert steps.min() >= -1e-9
    assert set(FEATURES.values()) == {-1, 0}


@pytest.mark.parametrize("values", [[0.0] * 40, [1.0] * 40])
def test_constant_features(values):
    trees = train_trees(np.array(values)[:, None], np.array([0.0, 1.0] * 20), [0], trees=3)
    assert np.allclose(trees.probability(np.array([[0.0], [5.0]])), 0.5)
