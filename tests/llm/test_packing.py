"""Packing: every id in exactly one piece, all limits held, little padding, the exact ids."""

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from llm_tables import docs, no_docs, odd_docs  # noqa: F401
from trialstats.llm.packing import Limits, Packer, pack
from trialstats.llm.tokenized import default_tokenizer_path


def _padding(lengths, tokens=4096):
    return sum(0 if n & (n - 1) == 0 else tokens - n for n in lengths)


def _check_packer(items, limits):
    p = Packer(limits, waiting=32)
    for i, (n, loss) in enumerate(items):
        p.add(i, n, loss)
    p.finish()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for example, start, size, loss, sequence, offset in p.placed:
        assert size > 0
        n, bearing = items[example]
        assert loss == max(0, start + size - max(start, n - bearing))
        pieces[example].append((start, size))
        sequences[sequence].append((offset, size, loss))
    for i, (n, _) in enumerate(items):
        at = 0
        for start, size in sorted(pieces[i]):
            assert start == at
            at += size
        assert at == n
    for rows in sequences.values():
        at = 0
        for offset, size, _ in sorted(rows):
            assert offset == at
            at += size
        assert at <= limits.tokens and len(rows) <= limits.segments and sum(r[2] for r in rows) <= limits.loss
    return [sum(r[1] for r in rows) for rows in sequences.values()]


def test_packer_holds_all_limits():
    rnd = random.Random(1)
    for limits in (Limits(64, 4, 64), Limits(64, 100, 20), Limits(4096, 256, 4096), Limits(16, 1, 3)):
        items = [(n, rnd.randrange(0, n + 1)) for n in (rnd.choice([1, 2, 5, 30, 63, 64, 65, 200]) for _ in range(300))]
        _check_packer(items, limits)
    assert _check_packer([], Limits()) == []


def test_little_padding():
    rnd = random.Random(2)
    items = [(n, n) for n in (int(rnd.lognormvariate(5.5, 1.2)) + 1 for _ in range(4000))]
    lengths = _check_packer(items, Limits())
    assert _padding(lengths) < 0.005 * sum(n for n, _ in items)


def _ids(text):
    return Tokenizer.from_file(default_tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [2]


def _check(rows, out):
    want = {}
    for r in rows:
        want.setdefault(r["doc_id"], []).append(_ids(r["text"]))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for d, own in pieces.items():
        assert sum(r["length"] for r in own) == sum(map(len, want[d]))
        for r in own:
            fitting = [ids for ids in want[d] if len(ids) == r["doc_tokens"] and zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
            assert fitting
            if r["input_ids"] is not None:
                assert r["input_ids"] in [ids[r["start"]:r["start"] + r["length"]] for ids in fitting]
    for rows_ in sequences.values():
        at = 0
        for offset, n in sorted(rows_):
            assert offset == at
            at += n
        assert at <= 4096


def test_documents(spark, docs, odd_docs, no_docs):
    some = docs.select("doc_id", "text")
    _check(some.collect(), pack(some).collect())
    _check(odd_docs.collect(), pack(odd_docs).collect())
    assert pack(no_docs).collect() == []


def test_full_pool_of_null_and_repeated_ids(spark):
    """More texts of unlike length than wait at once, with one id, few ids or none."""
    rnd = random.Random(4)
    texts = ["w " * rnd.choice([1, 3, 40, 400, 900]) + str(i) for i in range(3000)]
    for ids in ([None] * 3000, [i % 3 for i in range(3000)]):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1)
        out = pack(df, with_ids=False).groupBy("doc_id").agg({"length": "sum"}).collect()
        want = defaultdict(int)
        for d, t in zip(ids, texts):
            want[d] += len(_ids_fast(t))
        assert {r["doc_id"]: r["sum(length)"] for r in out} == want


_KNOWN = {}


def _ids_fast(text):
    if not _KNOWN:
        _KNOWN["t"] = Tokenizer.from_file(default_tokenizer_path())
    return _KNOWN["t"].encode(text, add_special_tokens=False).ids + [2]


def test_loss_counts(spark):
    df = spark.createDataFrame([(1, "a b c d", 2), (2, "a b", None), (3, "x", 99)], "doc_id long, text string, answer int")
    got = {r["doc_id"]: r["loss_tokens"] for r in pack(df, loss_col="answer").groupBy("doc_id").agg({"loss_tokens": "sum"}).withColumnRenamed("sum(loss_tokens)", "loss_tokens").collect()}
    assert got == {1: 2, 2: 3, 3: 2}
