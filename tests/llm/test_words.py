"""Words, shingles, tokens and packed columns against their plain definitions."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plain import shingles, words
from trialstats.llm import packed
from trialstats.llm.arrowtext import pieces, text_buffers
from trialstats.llm.tokenized import WordTokenizer, default_tokenizer_path
from trialstats.llm.words import WordHasher, distinct_by_text, shingle_hashes

TEXT = st.text(alphabet=st.sampled_from("abAB é\n\t.'0<|� "), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_and_shingles(texts):
    data, at = text_buffers(pa.array(texts, pa.string()))
    found = WordHasher()(data, at)
    assert found.counts.tolist() == [len(words(t)) for t in texts]
    by_word = {}
    flat = [w for t in texts for w in words(t)]
    assert all(by_word.setdefault(w, h) == h for w, h in zip(flat, found.hash.tolist()))
    assert len(set(by_word.values())) == len(by_word)
    _, bounds = distinct_by_text(*shingle_hashes(found))
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]


def test_pieces_keep_every_row():
    column = pa.array(["abc", None, "", "x" * 50, "de"] * 7).slice(3, 20)
    got = [data[at[i]:at[i + 1]].tobytes().decode() for row, end, data, at in pieces(column, limit=60) for i in range(end - row)]
    assert got == [x or "" for x in column.to_pylist()]
    assert list(pieces(pa.array([], pa.string()))) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abZ 'sé.,<|>09ßµ…\n×", "\u0301", "<|startoftext|>", "<|ENDOFTEXT|>", "'re", "İ", "好"]), max_size=30).map("".join), max_size=5))
def test_ids_equal_those_of_the_whole_text(texts):
    own = WordTokenizer(default_tokenizer_path())
    data, at = text_buffers(pa.array(texts, pa.string()))
    ids, bounds = own(data, at)
    whole = [own._tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == whole


def test_packed_columns_round_trip():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    counts = rng.integers(0, 1 << 40, 5000).astype(np.uint64)
    got = packed.unpack_sorted(packed.pack_sorted(keys, counts))
    assert (got[0] == keys).all() and (got[1] == counts).all()
    parts = list(packed.by_bucket(keys, 7))
    assert sum(s.stop - s.start for _, s in parts) == 5000 and [b for b, _ in parts] == sorted({b for b, _ in parts})
    assert packed.unpack(packed.pack(np.zeros(0, np.uint64)))[0].tolist() == []
    k, c = packed.summed(np.array([5, 3, 5], np.uint64), np.array([1, 2, 3], np.uint64))
    assert k.tolist() == [3, 5] and c.tolist() == [2, 4]
