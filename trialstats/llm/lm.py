"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of words and word pairs are gathered over all training texts. Each count is
quantised to a level of a geometric scale; the filter holds (n-gram, 1) up to
(n-gram, level), so a count is read by probing levels until one is missing. The
smoothed probability of a token comes from such probes:

    p1(w) = (c(w) + 1) / (N + V + 1)
    p2(w | h) = L c(h w) / c(h) + (1 - L) p1(w)

c(h w) takes the lower end of its level and c(h) the upper end, so that quantising
never overstates a share; a false positive of the filter can, by one level, at the
rate given below. L is the share of training tokens whose pair stays in the filter
with that token left out, a leave-one-out estimate over all counts; it is 0 after a
word too rare to begin such a pair.

Plan. The texts are hashed once, into blocks of tokens that are written. The distinct
n-grams of each block, with their counts in its training texts, are dealt in packed
lists over buckets of the key range; a frequent n-gram meets there as one entry per
block of text, not per occurrence. A bucket sums up its keys, builds its part of the
filter (``bits_per_entry`` bits an entry: 12 bits in words of 64, about one false
positive in 100 probes, measured in the tests), probes it for all keys that it was
sent, and returns the levels, and the exact counts of words, to their blocks. There
the texts are scored whole. The number of buckets follows the bytes of the text, so
the filter grows with the input, no part of it with the whole, and nothing but sums is
broadcast or sent to the driver. The cutoffs are ``least_counts`` at any size.

The base score takes the exact counts. Words with at least 1 in ``hot_share`` training
tokens take the level of their exact count, as they would need the most probes.

Edge cases. A null or empty text is the end token alone. A null id counts as the
empty string when folds are chosen. Repeated rows count and are scored each. Without
any training text N and V are 0. Empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.arrowtext import pieces
from trialstats.llm.packed import bucket_of, by_bucket, pack, pack_sorted, short_key, summed, unpack, unpack_sorted
from trialstats.llm.shared import written
from trialstats.llm.words import WordHasher, mix64

ORDERS = (1, 2)
END = np.uint64(0x5DEECE66D5DEECE6)
#: Tokens that a task gathers before it sends counts on.
BLOCK_TOKENS = 1_000_000
#: Bytes of text for each bucket of the key range.
BUCKET_BYTES = 24_000_000


@dataclass(frozen=True)
class Scale:
    """Lower ends of the count levels: whole numbers first, then growing by ``base``."""

    base: float = 1.4

    def ends(self, least: int = 1, most: int = 1 << 40) -> np.ndarray:
        out = [least]
        while out[-1] < most:
            out.append(max(out[-1] + 1, int(out[-1] * self.base)))
        return np.array(out, np.int64)


def token_hashes(hasher: WordHasher, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, text index) of every token; each text ends with the end token."""
    words = hasher(data, at)
    n = len(at) - 1
    tokens = np.full(len(words.hash) + n, END)
    tokens[np.arange(len(words.hash)) + words.text] = words.hash
    return tokens, np.repeat(np.arange(n), words.counts + 1)


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first follows the end token, as every text does."""
    before = np.concatenate([[END], tokens[:-1]])
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + mix64(tokens))


@dataclass
class Filter:
    """Log-frequency Bloom filter: one run of 64-bit words, cut into the buckets of the key range, for each order.

    All bits of an entry are in one word, so a probe reads one word.
    """

    words: dict[int, np.ndarray]  # of all buckets of an order
    begin: dict[int, np.ndarray]  # first word of each bucket, one more at the end
    least: dict[int, int]
    hashes: int
    scale: Scale
    weight: float  # L

    def parts(self) -> tuple:
        """The filter as plain values, whose bytes a task reads without copying them."""
        return {k: w.tobytes() for k, w in self.words.items()}, {k: b.tolist() for k, b in self.begin.items()}, self.least, self.hashes, self.scale.base, self.weight

    @classmethod
    def of(cls, parts: tuple) -> Filter:
        words, begin, least, hashes, base, weight = parts
        return cls({k: np.frombuffer(w, np.uint64) for k, w in words.items()}, {k: np.array(b, np.int64) for k, b in begin.items()}, least, hashes, Scale(base), weight)

    def levels(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Level of each key: number of consecutive levels found."""
        level = np.zeros(len(keys), np.int64)
        begin, words = self.begin[order], self.words[order]
        if not len(words):
            return level
        bucket = bucket_of(keys, len(begin) - 1).astype(np.int64)
        first, size = begin[bucket], np.diff(begin).astype(np.uint64)[bucket]
        active, j = np.arange(len(keys)), 0
        if not size.all():
            active = active[size > 0]
            keys, first, size = keys[active], first[active], size[active]
        while len(active):
            j += 1
            place, mask = _entry(keys, j, self.hashes)
            found = np.flatnonzero((words[first + ((place * size) >> np.uint64(32)).astype(np.int64)] & mask) == mask)
            active, keys, first, size = active[found], keys[found], first[found], size[found]
            level[active] = j
        return level

    def bounds(self, order: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper end of the counts of levels; below the cutoff 0 and the cutoff less one."""
        ends = np.concatenate([[0], self.scale.ends(self.least[order])])
        level = np.minimum(level, len(ends) - 2)
        return ends[level], ends[level + 1] - 1


def _entry(keys: np.ndarray, level: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(place as a 32-bit share of the bucket's words, bits within the word) of each key's entry for a level."""
    h = mix64(keys + np.uint64((level * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
    low = h * np.uint64(0xD6E8FEB86659FD93)
    mask = np.uint64(1) << (low >> np.uint64(58))
    for i in range(1, hashes):
        mask |= np.uint64(1) << ((low >> np.uint64(58 - 6 * i)) & np.uint64(63))
    return h >> np.uint64(32), mask


def fill_words(keys: np.ndarray, levels: np.ndarray, size: int, hashes: int) -> np.ndarray:
    """``size`` words with the entries of every key's levels 1 .. level."""
    words = np.zeros(size, np.uint64)
    for j in range(1, int(levels.max(initial=0)) + 1):
        place, mask = _entry(keys[levels >= j], j, hashes)
        np.bitwise_or.at(words, ((place * np.uint64(size)) >> np.uint64(32)).astype(np.int64), mask)
    return words


def build_filter(order: int, keys: np.ndarray, counts: np.ndarray, *, least: int, bits_per_entry: int = 12, hashes: int = 5, scale: Scale = Scale()) -> Filter:
    """The filter of one bucket's n-grams of an order (distinct ascending keys), as large as their entries ask for."""
    levels = np.searchsorted(scale.ends(least), counts.astype(np.int64), "right")
    size = -(-int(levels.sum()) * bits_per_entry // 64)
    words = fill_words(keys[levels > 0], levels[levels > 0], size, hashes)
    return Filter({order: words}, {order: np.array([0, size])}, {order: least}, hashes, scale, 0.0)


def _cutoffs(levels: dict[tuple[int, int], int], ends: np.ndarray, least_counts: tuple[int, ...], bits_per_entry: int, most_bits: int, scale: Scale) -> dict[int, int]:
    """The smallest cutoffs, raised for the longest n-grams first, whose entries keep to ``most_bits``.

    For callers that want a filter of bounded size; ``score`` keeps to its ``least_counts``.
    """
    least = dict(zip(ORDERS, least_counts))

    def entries(order: int) -> int:
        own = scale.ends(least[order])
        return sum(n * int(np.searchsorted(own, ends[level - 1], "right")) for (o, level), n in levels.items() if o == order)

    for order in reversed(ORDERS):
        while bits_per_entry * sum(map(entries, ORDERS)) > most_bits and entries(order):
            least[order] = int(ends[np.searchsorted(ends, least[order], "right")])
    return least


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None,
          least_counts: tuple[int, ...] = (1, 2), bits_per_entry: int = 12, hashes: int = 5, hot_share: int = 100_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; trained on the rows not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       (is_held_out(F.col(id_col)) if held_out is None else held_out).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    blocks = written(_token_blocks(rows), "lm-blocks")
    tokens = blocks.where("tokens is not null").select("block_id", "words", "tokens")
    found = written(_looked_up(tokens, buckets, least_counts, bits_per_entry, hashes), "lm-levels")
    n, v, kept = found.agg(F.sum(F.expr("if(order = 1, total, 0)")), F.sum(F.expr("if(order = 1, distinct, 0)")), F.sum("kept")).first()
    n, v, kept = n or 0, v or 0, kept or 0
    scored = _scored(tokens, found, n, v, min(kept / n, 0.95) if n else 0.0, least_counts, max(1, -(-n // hot_share)))
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return (blocks.where("tokens is null").join(scored, ["block_id", "place"])
            .select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"))


def _packed_tokens(tokens: np.ndarray, of_text: np.ndarray, train: np.ndarray) -> tuple[bytes, bytes]:
    """(distinct word hashes, tokens as places among them with the texts' token counts and folds) of a block.

    Frequent words have small places, and low and high bytes lie apart, so that the places compress.
    """
    words, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    at = place[at]
    return words[order].astype("<u8").tobytes(), zlib.compress(pack(at & 255, at >> 8, of_text, train), 1)


@dataclass
class Block:
    """A block's n-grams: distinct keys by order, ascending, and each token's place among them."""

    keys: dict[int, np.ndarray]
    at: dict[int, np.ndarray]
    before: np.ndarray  # place of the word before each token
    text: np.ndarray  # text of each token
    texts: int
    train: np.ndarray  # of each token

    @classmethod
    def of(cls, words: bytes, tokens: bytes) -> Block:
        low, high, of_text, train = (c.astype(np.int64) for c in unpack(zlib.decompress(tokens)))
        hashes, at = np.frombuffer(words, "<u8"), low | high << 8
        text = np.repeat(np.arange(len(of_text)), of_text)
        keys, place = np.unique(short_key(hashes), return_inverse=True)
        pairs, of_pair = np.unique(short_key(pair_hashes(hashes[at])), return_inverse=True)
        own = place[at]
        return cls({1: keys, 2: pairs}, {1: own, 2: of_pair}, np.concatenate([own[-1:], own[:-1]]), text, len(of_text), train[text])


def _token_blocks(rows: DataFrame) -> DataFrame:
    """One row per text (block_id, place, doc_id, held_out, n_tokens), and one per block with its words and tokens."""
    out = T.StructType([T.StructField("block_id", T.StringType()), T.StructField("place", T.IntegerType()), rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                        T.StructField("n_tokens", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        id_type: pa.DataType = pa.null()
        held: list[tuple] = []  # texts' columns, tokens
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            block_id = uuid.uuid4().hex
            ids, folds, counts = (pa.concat_arrays([h[k] for h in held]) for k in range(3))
            m = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([block_id] * m, pa.string()), pa.array(np.arange(m, dtype=np.int32)), ids, folds, counts, pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=out.names)
            words, tokens = _packed_tokens(np.concatenate([h[3] for h in held]), counts.to_numpy(), ~folds.fill_null(True).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([block_id]), pa.nulls(1, pa.int32()), pa.nulls(1, id_type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()),
                                              pa.array([words], pa.binary()), pa.array([tokens], pa.binary())], names=out.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for row, end, data, at in pieces(batch.column(1)):
                tokens, text = token_hashes(hasher, data, at)
                held.append((batch.column(0).slice(row, end - row), batch.column(2).slice(row, end - row), pa.array(np.bincount(text, minlength=end - row)), tokens))
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, out)


def _looked_up(tokens: DataFrame, buckets: int, least_counts: tuple[int, ...], bits_per_entry: int, hashes: int, scale: Scale = Scale()) -> DataFrame:
    """(block_id, order, bucket, found, total, distinct, kept): what the bucket knows of a block's n-grams, in key order.

    ``found`` holds the levels read from the bucket's filter, and before them the exact counts of words. The bucket's
    training tokens, distinct n-grams, and tokens of pairs that stay in the filter without one of them, are in one of its rows.
    """
    ends = scale.ends(1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, words, packed in zip(*(batch.column(i) for i in range(3))):
                block = Block.of(words.as_py(), packed.as_py())
                for order in ORDERS:
                    keys, counts = block.keys[order], np.bincount(block.at[order], block.train, len(block.keys[order])).astype(np.int64)
                    found = [(block_id.as_py(), order, b, pack_sorted(keys[s], counts[s])) for b, s in by_bucket(keys, buckets)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["block_id", "order", "bucket", "block"])

    def look_up(table: pa.Table) -> pa.Table:
        order, lists = table.column("order")[0].as_py(), table.column("block")
        keys, counts = summed(*(np.concatenate(c) for c in zip(*(unpack_sorted(b.as_py()) for b in lists))))
        known = counts > 0
        own = build_filter(order, keys[known], counts[known], least=least_counts[order - 1], bits_per_entry=bits_per_entry, hashes=hashes, scale=scale)
        levels = own.levels(order, keys)
        found = []
        for b in lists:
            at = np.searchsorted(keys, unpack_sorted(b.as_py())[0])
            found.append(pack(counts[at], levels[at]) if order == 1 else pack(levels[at]))
        seen = counts[known].astype(np.int64)
        stays = seen[ends[np.searchsorted(ends, seen, "right") - 1] > least_counts[1]].sum() if order == 2 else 0
        sums = [pa.array([int(x)] + [0] * (len(lists) - 1), pa.int64()) for x in (seen.sum(), len(seen), stays)]
        return pa.table([*(table.column(c) for c in ("block_id", "order", "bucket")), pa.array(found, pa.binary()), *sums], names=["block_id", "order", "bucket", "found", "total", "distinct", "kept"])

    dealt = tokens.mapInArrow(deal, "block_id string, order int, bucket int, block binary")
    return dealt.groupBy("bucket", "order").applyInArrow(look_up, "block_id string, order int, bucket int, found binary, total bigint, distinct bigint, kept bigint")


def _scored(tokens: DataFrame, found: DataFrame, n: int, v: int, share: float, least_counts: tuple[int, ...], hot: int, scale: Scale = Scale()) -> DataFrame:
    """(block_id, place, known, base, score) of each text: known tokens, sum of log10(count + 1), sum of log10 of the smoothed probabilities."""
    bounds = Filter({}, {}, dict(zip(ORDERS, least_counts)), 0, scale, share).bounds

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        block_id = left.column("block_id")[0].as_py()
        block = Block.of(left.column("words")[0].as_py(), left.column("tokens")[0].as_py())
        # the buckets are ascending ranges of the keys
        lists = sorted(zip(right.column("order").to_pylist(), right.column("bucket").to_pylist(), right.column("found").to_pylist()))
        of_word = [unpack(x) for order, _, x in lists if order == 1]
        counts, levels = (np.concatenate(c).astype(np.int64) for c in zip(*of_word))
        pair_levels = np.concatenate([unpack(x)[0] for order, _, x in lists if order == 2]).astype(np.int64)
        levels = np.where(counts >= hot, np.searchsorted(scale.ends(least_counts[0]), counts, "right"), levels)
        low, high = bounds(1, levels)
        pair_low, _ = bounds(2, pair_levels)
        at, m = block.at[1], block.texts
        seen = high[block.before]
        single = (low[at] + 1) / (n + v + 1)
        weight = np.where(low[block.before] >= least_counts[1], share, 0.0)
        p = weight * np.minimum(pair_low[block.at[2]], seen) / np.maximum(seen, 1) + (1 - weight) * single
        sums = np.bincount(block.text, counts[at] > 0, m).astype(np.int64), np.bincount(block.text, np.log10(counts + 1.0)[at], m), np.bincount(block.text, np.log10(p), m)
        return pa.table([pa.array([block_id] * m), pa.array(np.arange(m, dtype=np.int32)), *map(pa.array, sums)], names=["block_id", "place", "known", "base", "score"])

    both = tokens.groupBy("block_id").cogroup(found.select("block_id", "order", "bucket", "found").groupBy("block_id"))
    return both.applyInArrow(run, "block_id string, place int, known bigint, base double, score double")
