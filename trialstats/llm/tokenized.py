"""Token ids of many texts with one of the public tokenizers (path is a parameter).

The tokenizer sees each distinct piece of a task once; texts are put together from
the pieces' ids. Texts are cut at ASCII white space and wherever ASCII or Latin-1
letters, ASCII digits and ASCII punctuation (without the apostrophe) meet, places
where the tokenizer's own splitter always cuts, so the ids are those of the whole
text; tests compare the two. A tokenizer with another splitter, or a text with
``<|`` in it, takes a plainer way to the same ids.
"""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np

from trialstats.llm.words import WordHasher

#: Splitter and normaliser for which the cuts above hold (fixed values of the tokenizer's file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
_LETTER, _DIGIT, _MARK = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[ord("'")] = 0
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself where it prints, else the next free one from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """Ids of texts given as (bytes, offsets). ``memory``: distinct pieces kept between calls."""

    def __init__(self, path: str, memory: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        config = json.loads(self._tokenizer.to_str())
        pre = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self._by_piece = ([x.get("type") for x in (config.get("normalizer") or {}).get("normalizers", [])] == NORMALISERS
                          and [x.get("type") for x in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": SPLIT}
                          and not pre[1]["add_prefix_space"])
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._hasher = WordHasher()
        self._memory = memory
        self._forget()

    def _forget(self) -> None:
        self._place: dict[int, int] = {}
        self._start = np.zeros(0, np.int64)
        self._length = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, piece: bytes, letters_only: bool) -> list[int]:
        if letters_only:
            lower = piece.decode("utf-8").lower().encode("utf-8")
            return [t.id for t in self._model.tokenize("".join([self._letters[b] for b in lower]))]
        return self._whole(piece.decode("utf-8", "replace"))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) without any special token."""
        raw = data.tobytes()
        if not self._by_piece or b"<|" in raw:
            ids = [self._whole(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return np.array([i for x in ids for i in x], np.uint32), np.cumsum([0, *map(len, ids)])
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        cuts = np.zeros(len(data), bool)
        cuts[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        words = self._hasher(data, offsets, lower=True, cuts=cuts)
        if not len(words.hash):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self._place) > self._memory:
            self._forget()
        distinct, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        place = np.fromiter(map(self._place.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        if len(new):
            begin, end = words.start[at[new]], words.end[at[new]]
            others = np.concatenate([[0], np.cumsum(kind != _LETTER)])
            ids = [self._encode(raw[a:b], letters) for a, b, letters in zip(begin.tolist(), end.tolist(), (others[end] == others[begin]).tolist())]
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            place[new] = len(self._start) + np.arange(len(new))
            self._place.update(zip(distinct[new].tolist(), place[new].tolist()))
            self._start = np.concatenate([self._start, len(self._ids) + np.cumsum(length) - length])
            self._length = np.concatenate([self._length, length])
            self._ids = np.concatenate([self._ids, np.fromiter((i for x in ids for i in x), np.uint32, int(length.sum()))])
        of = place[inverse]
        length = self._length[of]
        end = np.cumsum(length)
        flat = np.arange(end[-1]) + np.repeat(self._start[of] - (end - length), length)
        return self._ids[flat], np.concatenate([[0], end])[words.first]
