"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

Terms are words (ASCII letters lower-cased, ASCII punctuation at their ends cut
off) and the first five bytes of longer words. The vocabulary holds all terms of the
training sample. Texts are vectors of (1 + ln tf) * idf over it, the document
frequencies counted over all documents.

The neighbours shown as evidence are the nearest by these whole vectors. A second
search takes the part of the vectors over the label terms: those that go with the
label in the sample, by a z score of the mean 1 + ln tf of the two kinds of texts. A
vote weights the labels of the nearest by the square of one minus the distance; the
mean of both votes is turned into a probability by an isotonic fit on leave-one-out
votes of the examples. Whole vectors alone speak of a text's subject more than of its
label (figures in the README).

Blocks hold like examples (grouped by their common terms, so that texts of one language or
kind lie together). Terms that are common in a block lie in its matrix, the others have posting lists.
A block's bound for a query is the least of two: the largest of its examples' scores by posting lists
and products of their norms over the matrix, and the same with the largest weight of each of its terms.
Like queries are searched together. Blocks are scored in the order of their bounds, the k-th best
score rising after each, and those whose bound does not reach it are not; so the k nearest are exact.

Plan. The classifier is fitted on a bounded sample of labelled rows
(``max_training_rows``, those with the smallest hashes of their id), which bounds the
vocabulary and the examples that are broadcast; each Python worker builds its index of them once. One
pass counts terms of the sample, one counts document frequencies (summed by ranges of
terms), one scores all documents; the last shuffles nothing.

Edge cases. A null or empty text, or one without a vocabulary term, has no vector; it
gets the smoothed share of positive labels among such examples; without a label term
that share among such examples is the second vote. Labels without an id or
value are left out; repeated labels each count. With no usable labels or terms every
text gets the smoothed share of all examples (one half without any). Ties between
neighbours go to the earlier example in index order. Null ids and repeated rows are
scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.arrowtext import pieces
from trialstats.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from trialstats.llm.shared import received, shipped, written
from trialstats.llm.words import WordHasher

PREFIX_BYTES = 5
#: Terms that more than one in so many examples hold are common to an index, or to a block of it.
COMMON_SHARE, BLOCK_SHARE = 16, 12
#: Texts that are dealt to batches of like ones, and texts in such a batch.
TEXTS, QUERIES = 512, 64
#: Groups of like examples, and the rounds that find them.
GROUPS, GROUP_ROUNDS = 8, 6
#: Examples whose votes a task finds.
EXAMPLES_A_TASK = 5_000
#: Examples in a block of an index.
EXAMPLE_BLOCK = 1024
#: Posting lists that are shorter are gathered at once.
SHORT_LIST = 96
#: Numbers of document frequencies that meet in one row.
FREQUENCY_BLOCK = 1 << 14
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_terms(hasher: WordHasher, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term hash, text index) of all terms of the texts, with repeats."""
    data = _LOWER[data]
    start, end, first = hasher.split(data, at)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if not len(text):
        return np.zeros(0, np.uint64), text
    mark = _MARK[data]
    core = np.flatnonzero(~mark)
    i = np.flatnonzero(mark[start])
    start[i] = np.append(core, len(data))[np.searchsorted(core, start[i])]
    i = np.flatnonzero(mark[end - 1])
    end[i] = np.append(core, -1)[np.searchsorted(core, end[i]) - 1] + 1
    some = start < end
    start, end, text = start[some], end[some], text[some]
    long = end - start > PREFIX_BYTES
    total = hasher.totals(data)
    whole = hasher.between(total, start, end)
    prefix = hasher.between(total, start[long], start[long] + PREFIX_BYTES) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    return np.concatenate([whole, prefix]), np.concatenate([text, text[long]])


class Vocabulary:
    """Ascending term hashes, found by their first bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each term, whether it is there)."""
        last = len(self.keys) - 1
        where = np.minimum(self.first[terms >> self.shift], last)
        behind = np.flatnonzero(self.keys[where] < terms)
        for _ in range(4):
            where[behind] = np.minimum(where[behind] + 1, last)
            behind = behind[(self.keys[where[behind]] < terms[behind]) & (where[behind] < last)]
        where[behind] = np.minimum(np.searchsorted(self.keys, terms[behind]), last)
        return where, self.keys[where] == terms


def term_counts(vocabulary: Vocabulary, hasher: WordHasher, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term index, tf) of the vocabulary terms in the texts, by text and term."""
    terms, text = text_terms(hasher, data, at)
    if not len(vocabulary) or not len(terms):
        return (np.zeros(0, np.int64),) * 3
    where, found = vocabulary.find(terms)
    both, tf = np.unique(text[found] * len(vocabulary) + where[found], return_counts=True)
    return both // len(vocabulary), both % len(vocabulary), tf


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + n[0] - 1, start[1] .. and so on."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def _like(x: np.ndarray, groups: int) -> np.ndarray:
    """The group of each row: rows near one of ``groups`` means by cosine. Any grouping gives the same neighbours."""
    x = x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    mean, of = x[np.linspace(0, len(x) - 1, groups).astype(int)], np.zeros(len(x), np.int64)
    for _ in range(GROUP_ROUNDS):
        of = (x @ mean.T).argmax(1)
        mean = (of == np.arange(groups)[:, None]).astype(np.float32) @ x
        mean /= np.maximum(np.sqrt((mean ** 2).sum(1)), 1e-9)[:, None]
    return of


@dataclass
class Block:
    """Weights of a block's examples for the terms that are common in it."""

    first: int
    end: int
    columns: np.ndarray  # of the queries' matrix
    weight: np.ndarray  # (examples, columns)
    norm: np.ndarray  # of its rows
    most: np.ndarray  # of its columns


@dataclass
class BlockMaxIndex:
    """Examples' vectors of positive weights: blocks of like examples by the terms common there, and posting lists of all else."""

    start: np.ndarray  # of each term's postings, one more at the end
    posting: np.ndarray  # weights, the last bits of which are the place of the example
    place_bits: np.int64
    column: np.ndarray  # of each term that is common in some block; -1 for others
    width: int  # number of such terms
    blocks: list[Block]
    mean: np.ndarray  # of each block, by those terms, of length one
    order: np.ndarray  # the example at each place
    rows: tuple[np.ndarray, np.ndarray, np.ndarray]  # examples' starts, terms and exact weights
    n: int

    @classmethod
    def build(cls, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int, block: int = 64) -> BlockMaxIndex:
        if (example[1:] < example[:-1]).any():
            order = np.argsort(example, kind="stable")
            example, term, weight = example[order], term[order], weight[order]
        begin = np.searchsorted(example, np.arange(n + 1))
        order, cuts = cls._order(example, term, weight, n, terms, block)
        place, blocks, held, rare = np.empty(terms, np.int32), [], [], []
        for a, b in cuts:
            m = begin[order[a:b] + 1] - begin[order[a:b]]
            at = _ranges(begin[order[a:b]], m)
            of, row = term[at], np.repeat(np.arange(b - a, dtype=np.int32), m)
            often = np.flatnonzero(np.bincount(of, minlength=terms) * BLOCK_SHARE > b - a)
            place.fill(-1)
            place[often] = np.arange(len(often))
            where = place[of]
            own = where >= 0
            matrix = np.zeros((b - a, len(often)), np.float32)
            matrix[row[own], where[own]] = weight[at[own]]
            held.append(often)
            blocks.append(Block(a, b, often, matrix, np.sqrt(np.einsum("ij,ij->i", matrix, matrix)), matrix.max(0)))
            rare.append((of[~own], row[~own] + np.int32(a), weight[at[~own]].astype(np.float32)))
        union = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]))
        column = np.full(terms, -1, np.int32)
        column[union] = np.arange(len(union))
        for one in blocks:
            one.columns = column[one.columns]
        of, at, value = (np.concatenate([r[i] for r in rare] or [np.zeros(0, kind)]) for i, kind in enumerate((np.int32, np.int32, np.float32)))
        del rare
        start = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=terms))])
        by_term = of.astype(np.uint64) << np.uint64(32) | np.arange(len(of), dtype=np.uint64)
        del of
        by_term.sort()
        by_term &= np.uint64(0xFFFFFFFF)
        place_bits = np.int64((1 << n.bit_length()) - 1)
        posting = value[by_term].astype(float)
        posting.view(np.int64)[:] &= ~place_bits
        posting.view(np.int64)[:] |= at[by_term]
        mean = np.zeros((len(blocks), len(union)), np.float32)
        for i, one in enumerate(blocks):
            mean[i, one.columns] = one.weight.sum(0)
        mean /= np.maximum(np.sqrt((mean ** 2).sum(1)), 1e-9)[:, None]
        return cls(start, posting, place_bits, column, len(union), blocks, mean, order, (begin, term.astype(np.int32, copy=False), weight.astype(float, copy=False)), n)

    @staticmethod
    def _order(example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int, block: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(examples with like ones side by side, first and end place of each block)."""
        if not n:
            return np.zeros(0, np.int64), []
        often = np.flatnonzero(np.bincount(term, minlength=terms) * COMMON_SHARE > n)
        column = np.full(terms, -1, np.int32)
        column[often] = np.arange(len(often))
        own = np.flatnonzero(column[term] >= 0)
        x = np.zeros((n, len(often)), np.float32)
        x[example[own], column[term[own]]] = weight[own]
        of = _like(x, min(GROUPS, n))
        cuts, a = [], 0
        for size in np.bincount(of):
            parts = -(-int(size) // block)
            cuts += [(a + size * i // parts, a + size * (i + 1) // parts) for i in range(parts)]
            a += int(size)
        return np.argsort(of, kind="stable"), [(int(i), int(j)) for i, j in cuts]

    def _rare(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Every place's dot products with the queries over their posting lists."""
        score = np.empty((len(queries), self.n), np.float32)
        sizes = [self.start[term + 1] - self.start[term] for term, _ in queries]
        most = max(int(m.sum()) for m in sizes)
        postings, places = np.empty(most), np.empty(most, np.int64)
        for i, ((term, weight), m) in enumerate(zip(queries, sizes)):
            first = self.start[term]
            short, long = np.flatnonzero(m < SHORT_LIST), np.flatnonzero(m >= SHORT_LIST)
            both = np.concatenate([long, short])
            found, place = postings[:int(m.sum())], places[:int(m.sum())]
            np.concatenate([*(self.posting[a:b] for a, b in zip(first[long].tolist(), (first[long] + m[long]).tolist())), self.posting[_ranges(first[short], m[short])]], out=found)
            np.bitwise_and(found.view(np.int64), self.place_bits, out=place)
            found *= np.repeat(weight[both], m[both])
            score[i] = np.bincount(place, found, self.n)
        return score

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, positive weights) the k examples with the largest positive dot products, exactly.

        Like queries are searched together. Blocks are scored in the order of their bounds, in single precision, and the
        k-th best score so far is raised after each; all within the rounding error of the last one are scored anew in
        double precision.
        """
        q = len(queries)
        if not q or not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * q
        asked, skip = np.zeros((q, self.width), np.float32), np.full(q, -1)
        for i, (term, weight) in enumerate(queries):
            column = self.column[term]
            own = np.flatnonzero(column >= 0)
            asked[i, column[own]] = weight[own]
        if without is not None:
            some = np.flatnonzero(np.array(without) >= 0)
            place = np.empty(self.n, np.int64)
            place[self.order] = np.arange(self.n)
            skip[some] = place[np.array(without)[some]]
        out: list = [None] * q
        like = np.argsort((asked @ self.mean.T).argmax(1), kind="stable")
        for a in range(0, q, QUERIES):
            batch = like[a:a + QUERIES]
            some = [queries[i] for i in batch]
            for i, found in zip(batch, self._exact(some, self._candidates(some, asked[batch], skip[batch], k), k)):
                out[i] = found
        return out

    def _candidates(self, queries: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, skip: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the examples that may be among its k nearest; ``skip``: a place left out, or -1."""
        error = (max(len(b.columns) for b in self.blocks) + 16) * 2.0 ** -22
        score = self._rare(queries)
        left_out = np.flatnonzero(skip >= 0)
        score[left_out, skip[left_out]] = 0
        own, bound = [asked[:, b.columns] for b in self.blocks], np.empty((len(queries), len(self.blocks)), np.float32)
        for j, b in enumerate(self.blocks):
            rare = score[:, b.first:b.end]
            bound[:, j] = np.minimum((rare + np.sqrt(np.einsum("ij,ij->i", own[j], own[j]))[:, None] * b.norm).max(1), rare.max(1) + own[j] @ b.most)
        bound *= 1 + error
        least, best = np.zeros(len(queries), np.float32), np.zeros((len(queries), k), np.float32)
        done = np.zeros(bound.shape, bool)
        for j in np.argsort(-bound.sum(0), kind="stable"):
            need = np.flatnonzero((bound[:, j] > 0) & (bound[:, j] >= least * (1 - error)))
            if not len(need):
                continue
            a, b = self.blocks[j].first, self.blocks[j].end
            scored = score[need, a:b]
            scored += own[j][need] @ self.blocks[j].weight.T
            here = np.flatnonzero((skip[need] >= a) & (skip[need] < b))
            scored[here, skip[need[here]] - a] = 0
            score[need, a:b] = scored
            done[need, j] = True
            up = scored.max(1) > least[need]
            better = need[up]
            best[better] = np.partition(np.concatenate([best[better], scored[up]], axis=1), -k, axis=1)[:, -k:]
            least[better] = best[better].min(1)
        for j, b in enumerate(self.blocks):
            score[~done[:, j], b.first:b.end] = 0
        least = np.maximum(least * (1 - error), np.finfo(np.float32).tiny)
        return [self.order[np.flatnonzero(row >= x)] for row, x in zip(score, least)]

    def _exact(self, queries: list[tuple[np.ndarray, np.ndarray]], candidates: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best candidates of each query, by dot products in double precision."""
        out = []
        begin, of, exact = self.rows
        asked, values = np.zeros(len(self.column), bool), np.zeros(len(self.column))
        for (term, weight), found in zip(queries, candidates):
            asked[term], values[term] = True, weight
            a, m = begin[found], begin[found + 1] - begin[found]
            terms = np.concatenate([of[i:j] for i, j in zip(a.tolist(), (a + m).tolist())] or [of[:0]])
            shared = np.flatnonzero(asked.take(terms, mode="clip"))
            ends = np.cumsum(m)
            row = np.searchsorted(ends, shared, side="right")
            dot = np.bincount(row, exact[shared + (a - (ends - m))[row]] * values[terms[shared]], len(found))
            asked[term], values[term] = False, 0
            top = np.lexsort((found, -np.round(dot, 12)))[:k]
            out.append((found[top], dot[top]))
        return out

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """``nearest_of`` for one query; ``without`` leaves one example out."""
        return self.nearest_of([(term, weight)], k, [without])[0]


def isotonic(x: np.ndarray, y: np.ndarray, bins: int = 25, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising map from votes to shares: smoothed shares by vote bin, pooled where they would fall."""
    mean = float(y.mean()) if len(y) else 0.5
    of = np.minimum((x * bins).astype(int), bins - 1)
    n = np.bincount(of, minlength=bins).astype(float)
    value = (np.bincount(of, y, bins) + prior * mean) / (n + prior)
    pools: list[list[float]] = []
    for b in np.flatnonzero(n):
        pools.append([value[b], n[b], b, b])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, m, _, last = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + v * m) / (pools[-1][1] + m), pools[-1][1] + m, pools[-1][2], last]
    if not pools:
        return np.array([0.0, 1.0]), np.array([mean, mean])
    knots = [((p[i] + 0.5) / bins, p[0]) for p in pools for i in ((2, 3) if p[2] != p[3] else (2,))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


def _packed_lists(start: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Starts, terms (as differences) and tfs of the examples."""
    steps = np.diff(term.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return tuple(zlib.compress(c.tobytes(), 1) for c in (start.astype("<i8"), steps, tf.astype("<i4")))


def _lists(packed: tuple[bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, steps, tf = (np.frombuffer(zlib.decompress(c), t) for c, t in zip(packed, ("<i8", "<u4", "<i4")))
    return start, np.cumsum(steps, dtype=np.uint32).view(np.int32), tf


@dataclass
class View:
    """Unit TF-IDF vectors of the examples over some of the terms, and their index."""

    column: np.ndarray  # of each term of the vocabulary; -1 if not in the view
    idf: np.ndarray  # of the view's terms
    index: BlockMaxIndex

    @classmethod
    def build(cls, chosen: np.ndarray, idf: np.ndarray, example: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> View:
        column = np.full(len(idf), -1, np.int32)
        column[chosen] = np.arange(len(chosen))
        # terms in all documents weigh nothing; large arrays are worked on in place, as every task holds its own
        own = (column[term] >= 0) & (idf[term] > 0)
        example, term, weight = example[own], column[term[own]], np.log(tf[own])
        weight += 1
        weight *= idf[chosen][term]
        weight /= np.sqrt(np.bincount(example, weight ** 2, n))[example]
        return cls(column, idf[chosen], BlockMaxIndex.build(example, term, weight, n, len(chosen), EXAMPLE_BLOCK))

    def query(self, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = self.column[term]
        own = column >= 0
        weight = (1 + np.log(tf[own])) * self.idf[column[own]]
        some = weight > 0
        weight = weight[some]
        return column[own][some], weight / np.sqrt((weight ** 2).sum()) if len(weight) else weight


@dataclass
class Classifier:
    keys: np.ndarray
    idf: np.ndarray
    label_terms: np.ndarray
    examples: tuple[bytes, bytes, bytes]  # starts, terms and tfs of the examples, packed
    ids: list
    labels: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]
    without_terms: float
    without_label_terms: float
    k: int

    def views(self) -> tuple[View, View] | None:
        """The examples by all their terms, and by those that go with the label; built where they are searched."""
        if not len(self.ids):
            return None
        start, term, tf = _lists(self.examples)
        example = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(start))
        return tuple(View.build(chosen, self.idf, example, term, tf, len(self.ids)) for chosen in (np.arange(len(self.keys)), self.label_terms))

    def votes(self, views: tuple[View, View] | None, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
        """(vote, neighbours by all terms, their cosines) of some texts (terms, tfs); a vote of None without any neighbour."""
        if views is None:
            return [(None, np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        whole, label = ([*view.index.nearest_of([view.query(*t) for t in texts], self.k, without)] for view in views)
        out = []
        for (found, cosine), (near, likeness) in zip(whole, label):
            of_label = self._vote(near, likeness)
            of_all = self._vote(found, cosine)
            both = None if of_all is None else (of_all + (self.without_label_terms if of_label is None else of_label)) / 2
            out.append((both, found, cosine))
        return out

    def _vote(self, found: np.ndarray, cosine: np.ndarray) -> float | None:
        share = cosine ** 2
        return float((share * self.labels[found]).sum() / share.sum()) if len(found) and share.sum() > 0 else None

    def score(self, vote: float | None) -> float:
        return self.without_terms if vote is None else float(np.interp(vote, *self.knots))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """(the bounded sample of labels, all documents with the sample's label or null)."""
    some = (labels.select(F.col(label_id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).dropna()
            .orderBy(F.xxhash64("label_id"), "label_id", "label").limit(rows))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return some, texts


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic",
          max_training_rows: int = 20_000, max_terms: int = 2_000, least_z: float = 5.0, least_texts: int = 4, neighbours: int = 15) -> Classifier:
    """Classifier from ``labels`` (only the rows to learn from) and the texts of ``docs``."""
    sample, texts = _sample(docs, labels, id_col, text_col, label_id_col, label_col, max_training_rows)
    labelled = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for row, end, data, at in pieces(batch.column(0)):
                terms, text = text_terms(hasher, data, at)
                order = np.lexsort((text, terms))
                terms, text = terms[order], text[order]
                first = np.concatenate([[True], (terms[1:] != terms[:-1]) | (text[1:] != text[:-1])]) if len(terms) else np.zeros(0, bool)
                begin = np.flatnonzero(first)
                weight = 1 + np.log(np.diff(begin, append=len(terms)))
                key, of = np.unique(terms[first], return_inverse=True)
                positive = label[row + text[first]] == 1
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(of, positive, len(key)).astype(float), pa.float64()), pa.array(np.bincount(of, weight * positive, len(key)).astype(float), pa.float64()),
                                                  pa.array(np.bincount(of, weight * ~positive, len(key)).astype(float), pa.float64()), pa.array(np.bincount(of, weight ** 2, len(key)).astype(float), pa.float64())], names=["key", "texts", "a", "b", "squares"])

    share = labelled.groupBy(F.col("label") == 1).count().collect()
    n1 = sum(r["count"] for r in share if r[0])
    n0 = sum(r["count"] for r in share if not r[0])
    keys, label_terms = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n1 and n0:
        mean = (F.col("a") + F.col("b")) / (n0 + n1)
        z = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt((F.col("squares") / (n0 + n1) - mean * mean) * (1 / n0 + 1 / n1) + 1e-12)
        sums = ("texts", "a", "b", "squares")
        found = (labelled.mapInArrow(count, "key bigint, texts double, a double, b double, squares double").groupBy("key").agg(*[F.sum(c).alias(c) for c in sums])
                 .select("key", F.when((F.col("texts") >= least_texts) & (z >= least_z), z).otherwise(0.0).alias("z")).toArrow())
        keys, z = found.column("key").to_numpy().view(np.uint64), found.column("z").to_numpy()
        order = np.argsort(keys)
        keys, z = keys[order], z[order]
        best = np.lexsort((keys.view(np.int64), -z))[:max_terms]
        label_terms = np.sort(best[z[best] > 0])
    frequency, n, examples = _frequencies(texts, sample, keys)
    idf = np.log((n + 1) / (frequency + 1))
    labels_of = np.array([e[1] for e in examples], float)
    is_label_term = np.zeros(len(keys), bool)
    is_label_term[label_terms] = True

    def rate(chosen: np.ndarray) -> float:
        return float((labels_of[chosen].sum() + 0.5) / (chosen.sum() + 1)) if chosen.any() else float((labels_of.sum() + 0.5) / (len(labels_of) + 1))

    without_terms = rate(np.array([len(e[2]) == 0 for e in examples], bool))
    without_label_terms = rate(np.array([not is_label_term[e[2]].any() for e in examples], bool))
    # like examples side by side, so that a block's bound is close to its members'
    held = sorted((e for e in examples if len(e[2])), key=lambda e: (int(e[2][np.argmax((1 + np.log(e[3])) * idf[e[2]])]), e[1], str(e[0])))
    lists = (np.concatenate([[0], np.cumsum([len(e[2]) for e in held])]).astype(np.int64), *(np.concatenate([e[i] for e in held] or [np.zeros(0, np.int32)]) for i in (2, 3)))
    model = Classifier(keys, idf, label_terms, _packed_lists(*lists), [e[0] for e in held], np.array([e[1] for e in held], float), (np.array([0.0, 1.0]), np.full(2, without_terms)),
                       without_terms, without_label_terms, neighbours)
    if not held:
        return model
    del examples, held, lists
    votes = _votes_of_examples(docs.sparkSession, model)
    known = np.array([v is not None for v in votes])
    model.knots = isotonic(np.array([v for v in votes if v is not None]), model.labels[known])
    return model


def _votes_of_examples(spark: SparkSession, model: Classifier) -> list[float | None]:
    """Each example's vote by the others, found on the executors."""
    shared, n = shipped(spark, model), len(model.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, views, (start, term, tf) = received(shared, lambda model: (model, model.views(), _lists(model.examples)))
        for batch in batches:
            of = batch.column(0).to_pylist()
            for i in range(0, len(of), TEXTS):
                some = of[i:i + TEXTS]
                votes = own.votes(views, [(term[start[e]:start[e + 1]], tf[start[e]:start[e + 1]]) for e in some], some)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([v for v, _, _ in votes], pa.float64())], names=["example", "vote"])

    found = spark.range(0, n, 1, -(-n // EXAMPLES_A_TASK)).mapInArrow(run, "example bigint, vote double").toArrow()
    shared.destroy()
    return found.sort_by("example").column("vote").to_pylist()


def _frequencies(texts: DataFrame, sample: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, int, list[tuple]]:
    """(documents that hold each term, all documents, the sample's rows as (id, label, terms, tfs)), from one pass over all documents."""
    joined = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "text", "label")
    out = T.StructType([joined.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()),
                        T.StructField("block", T.BinaryType())])
    shared = shipped(texts.sparkSession, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = received(shared, Vocabulary)
        hasher, total, n, id_type = WordHasher(), np.zeros(len(keys), np.int64), 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            label = batch.column(2).to_pylist()
            n += len(label)
            for row, end, data, at in pieces(batch.column(1)):
                text, term, tf = term_counts(keys, hasher, data, at)
                total += np.bincount(term, minlength=len(keys))
                bounds = np.searchsorted(text, np.arange(end - row + 1))
                some = [i for i in range(end - row) if label[row + i] is not None]
                if some:
                    lists = pa.array([pack_sorted(term[bounds[i]:bounds[i + 1]].astype(np.uint64), tf[bounds[i]:bounds[i + 1]]) for i in some], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row + i for i in some])), pa.array([label[row + i] for i in some], pa.int32()),
                                                      pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.int64()), lists], names=out.names)
        if n:
            at = range(0, max(1, len(keys)), FREQUENCY_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), id_type), pa.nulls(len(at), pa.int32()), pa.array(range(len(at)), pa.int32()), pa.array([n] * len(at), pa.int64()),
                                              pa.array([pack(total[a:a + FREQUENCY_BLOCK]) for a in at], pa.binary())], names=out.names)

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([unpack(x.as_py())[0].astype(np.int64) for x in table.column("block")], axis=0)
        return pa.table({"part": table.column("part")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "total": pa.array([pack(total)], pa.binary())})

    counted = written(joined.mapInArrow(run, out), "toxicity-terms")
    sums = sorted(counted.where("part is not null").select("part", "n", "block").groupBy("part").applyInArrow(add, "part int, n bigint, total binary").collect())
    frequency = np.concatenate([unpack(bytes(r["total"]))[0].astype(np.int64) for r in sums]) if sums else np.zeros(len(keys), np.int64)
    examples = [(r["doc_id"], int(r["label"] == 1), *(c.astype(np.int32) for c in unpack_sorted(bytes(r["block"]))))
                for r in counted.where("part is null").select("doc_id", "label", "block").toLocalIterator()]
    return frequency, sums[0]["n"] if sums else 0, examples


def score(docs: DataFrame, model: Classifier, *, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.7, evidence: int = 3) -> DataFrame:
    """Per row: doc_id, score, predicted, and as evidence the nearest examples (doc_id, label, cosine)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found_type = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    out = T.StructType([texts.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(found_type))])
    arrow = pa.list_(pa.struct([("doc_id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))
    shared = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, views, vocabulary = received(shared, lambda model: (model, model.views(), Vocabulary(model.keys)))
        hasher = WordHasher()
        for batch in batches:
            scores, shown = np.full(batch.num_rows, own.without_terms), [[] for _ in range(batch.num_rows)]
            for row, _, data, at in pieces(batch.column(1)):
                text, term, tf = term_counts(vocabulary, hasher, data, at)
                starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
                ends = np.append(starts, len(text))[1:]
                for first in range(0, len(starts), TEXTS):
                    bounds = list(zip(starts[first:first + TEXTS], ends[first:first + TEXTS]))
                    for (a, _), (vote, found, cosine) in zip(bounds, own.votes(views, [(term[a:b], tf[a:b]) for a, b in bounds])):
                        i = row + int(text[a])
                        scores[i] = own.score(vote)
                        shown[i] = [{"doc_id": str(own.ids[e]), "label": int(own.labels[e]), "cosine": float(c)} for e, c in zip(found[:evidence], cosine[:evidence])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= least_score).astype(np.int32)), pa.array(shown, arrow)], names=out.names)

    return texts.mapInArrow(run, out)
