"""Toxicity: exact neighbours, calibration, held-out accuracy, folds, odd rows."""

import pickle

import numpy as np
from pyspark.sql import functions as F

from llm_tables import docs, no_docs, odd_docs  # noqa: F401
from trialstats.llm.shared import received
from trialstats.llm.toxicity import BlockMaxIndex, Vocabulary, isotonic, score, text_terms, train
from trialstats.llm.words import WordHasher


def test_neighbours_are_exact():
    rng = np.random.default_rng(0)
    for n, block in ((300, 16), (64, 64), (5, 4)):
        x = rng.random((n, 30)) * (rng.random((n, 30)) < 0.2)
        x[rng.integers(0, n, n // 4)] = x[0]  # ties
        e, t = np.nonzero(x)
        index = BlockMaxIndex.build(e, t, x[e, t], n, 30, block)
        for _ in range(60):
            q = rng.random(30) * (rng.random(30) < 0.15)
            term = np.flatnonzero(q)
            if not len(term):
                continue
            exact = x @ q
            for without in (-1, 0):
                own = exact.copy()
                if without >= 0:
                    own[without] = 0
                want = np.sort(own[own > 0])[::-1][:7]
                found, cosine = index.nearest(term, q[term], 7, without)
                assert np.allclose(cosine, want) and np.allclose(exact[found], cosine) and without not in found and len(set(found.tolist())) == len(found)


def test_blocks_of_other_kinds_are_not_scored():
    """Examples of four kinds in turn, without a term in common: a query meets the blocks of its own kind only."""
    rng = np.random.default_rng(4)
    kind = np.arange(400) % 4
    x = rng.random((400, 80)) * (rng.random((400, 80)) < 0.4) * (np.arange(80) // 20 == kind[:, None])
    e, t = np.nonzero(x)
    for own in range(4):
        index = BlockMaxIndex.build(e, t, x[e, t], 400, 80, 64)
        for block in index.blocks:
            if set(kind[index.order[block.first:block.end]].tolist()) != {own}:
                block.weight = None  # an error if scored
        q = rng.random((30, 80)) * (np.arange(80) // 20 == own)
        for (found, cosine), one in zip(index.nearest_of([(np.flatnonzero(r), r[r > 0]) for r in q], 9), q):
            assert np.allclose(cosine, np.sort(x @ one)[::-1][:9]) and np.allclose((x @ one)[found], cosine)


def test_terms_are_found():
    rng = np.random.default_rng(5)
    crowded = np.arange(40, dtype=np.uint64) * np.uint64(3) + np.uint64(1 << 63)
    for keys in (rng.integers(0, 1 << 64, 500, np.uint64), crowded, np.concatenate([crowded, rng.integers(0, 1 << 64, 90, np.uint64)]), crowded[:1]):
        keys = np.unique(keys)
        terms = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 500, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        where, found = Vocabulary(keys).find(terms)
        assert (found == np.isin(terms, keys)).all() and (keys[where[found]] == terms[found]).all()


def test_a_worker_builds_its_index_once():
    class Sent:
        value = pickle.dumps([1, 2])

    sent, built = Sent(), []
    assert received(sent, lambda v: built.append(v) or built) is received(sent, lambda v: built.append(v)) and built == [[1, 2]]


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    x = rng.random(500)
    knots, value = isotonic(x, (rng.random(500) < x).astype(float))
    assert (np.diff(value) >= 0).all() and (np.diff(knots) > 0).all() and 0 <= value.min() and value.max() <= 1


def test_terms():
    def terms(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return set(text_terms(WordHasher(), data, np.array([0, len(data)]))[0].tolist())

    assert terms("Idiot!! (idiot) \"IDIOT\"") == terms("idiot") and len(terms("idiot")) == 1
    assert len(terms("disgusting")) == 2 and terms("disgusting") & terms("disguised") and terms("... !! --") == set()


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = train(docs, labels.where(~held_out))
    got = score(docs, model).join(labels.where(held_out), "doc_id").select("score", "predicted", "toxic", "evidence").collect()
    hit = [r for r in got if r["predicted"]]
    assert np.mean([r["toxic"] for r in hit]) > 0.95 and len(hit) > 0.6 * sum(r["toxic"] for r in got)
    assert all(0 <= r["score"] <= 1 and (r["predicted"] == 1) == (r["score"] >= 0.7) for r in got)
    assert all(r["evidence"] and r["evidence"][0]["cosine"] <= 1 + 1e-9 for r in hit)


def test_labels_of_other_folds_do_not_matter(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    turned = labels.withColumn("toxic", F.when(fold == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(str, score(docs, train(docs, x.where(fold != 1))).collect())) for x in (labels, turned))
    assert one == two


def test_odd_rows(spark, docs, odd_docs, no_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = train(docs, labels)
    assert len(score(odd_docs, model).collect()) == odd_docs.count() and score(no_docs, model).collect() == []
    schema = "doc_id long, toxic int"
    for rows in ([], [(None, 1), (1, None)], [(1, 1)]):
        got = score(odd_docs, train(odd_docs, spark.createDataFrame(rows, schema))).collect()
        assert len({r["score"] for r in got}) == 1 and all(r["evidence"] == [] for r in got)


def test_neighbours_are_those_of_whole_vectors(spark):
    """Also terms that say nothing of the label, or speak for label 0, belong to the vectors and their norms."""
    common = "alpha beta gamma delta"
    rows = [(i, f"rude{i % 3} {common} mix{i % 2} own{i}") for i in range(12)] + [(i, f"kind{i % 4} {common} mix{i % 2} own{i}") for i in range(12, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(40)], "doc_id long, toxic int")
    terms = [set(t.split()) for _, t in rows]
    every = sorted(set().union(*terms))
    idf = np.log([41 / (sum(t in s for s in terms) + 1) for t in every])
    x = np.array([[t in s for t in every] for s in terms]) * idf
    x /= np.sqrt((x ** 2).sum(1))[:, None]
    model = train(docs, labels, least_z=0.1, least_texts=2)
    got = {r["doc_id"]: r["evidence"] for r in score(docs, model, evidence=15).collect()}
    for i in range(40):
        want = x @ x[i]
        assert np.allclose([e["cosine"] for e in got[i]], np.sort(want)[::-1][:len(got[i])]) and len(got[i]) == 15
        assert np.allclose([want[int(e["doc_id"])] for e in got[i]], [e["cosine"] for e in got[i]])


def test_examples_are_not_cut_below_the_first_bound():
    from inspect import signature

    assert signature(train).parameters["max_training_rows"].default >= 20_000 and signature(train).parameters["max_terms"].default >= 2_000
