"""Benchmark decontamination against brute force, at and around the threshold."""

import random

from llm_tables import no_docs, odd_docs  # noqa: F401
from plain import shingles
from trialstats.llm.decontaminate import find_leaks, without_leaks


def _want(rows, items):
    out = set()
    for d, t in rows:
        own = shingles(t)
        for i, x in items:
            its = shingles(x)
            if its and 100 * len(own & its) >= 75 * len(its):
                out.add((d, i, len(own & its), len(its)))
    return sorted(out, key=str)


def _got(df):
    return sorted({tuple(r) for r in df.collect()}, key=str)


def _data():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 4, 5, 6, 7, 9, 20, 45])))) for i in range(60)]
    rows = []
    for d in range(150):
        text = rnd.choices(words, k=rnd.choice([3, 30, 400]))
        for _, x in rnd.sample(items, 3):
            w = x.split()
            for _ in range(rnd.randrange(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            cut = rnd.randrange(0, len(w) // 3 + 1)
            at = rnd.randrange(len(text) + 1)
            text[at:at] = w[cut:]
        rows.append((d, " ".join(text)))
    return rows + [(900 + i, x) for i, (_, x) in enumerate(items[:8])], items


def test_equals_brute_force(spark):
    rows, items = _data()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = _want(rows, items)
    assert len(want) > 50
    for block in (1 << 20, 100):
        assert _got(find_leaks(docs, bench, block_shingles=block)) == want
        clean = {r["doc_id"] for r in without_leaks(docs, bench, block_shingles=block).collect()}
        assert clean == {d for d, _ in rows} - {w[0] for w in want}


def test_odd_rows(spark, odd_docs, no_docs):
    schema = "item_id long, text string, doc_id long"
    items = [(1, "A b c D e f"), (1, "A b c D e f"), (2, None), (3, ""), (None, "one two"), (4, "a b c d"), (5, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6")]
    bench = spark.createDataFrame([(*i, 0) for i in items], schema)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = find_leaks(odd_docs, bench)
    assert _got(got) == _want(rows, items)
    assert got.where("doc_id = 1").count() == 2  # a repeated document counts each time, a repeated item once
    assert without_leaks(odd_docs, bench).columns == odd_docs.columns
    assert find_leaks(no_docs, bench).collect() == [] and without_leaks(no_docs, bench).collect() == []
    empty = spark.createDataFrame([], schema)
    assert find_leaks(odd_docs, empty).collect() == [] and without_leaks(odd_docs, empty).count() == odd_docs.count()
