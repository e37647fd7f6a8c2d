"""N-gram Jaccard join: which documents share at least 75 % of their word 5-grams.

A document's set holds its distinct shingles; equal sets are one set, known by a
64-bit hash of its members (and its size). The join is size-aware:

* *Light* sets, of at most x shingles, enumerate the 2-subsets of a prefix; linked
  light sets share one.
* *Heavy* sets scan inverted lists of single shingles of a shorter prefix; the
  lists also hold the light sets that are large enough to link with a heavy one.
* The boundary x has the least cost over the actual numbers of sets by size: one
  for each subset key of a light set, ``scan_cost`` for each entry of a list.

Prefixes follow one global order of shingles, rare ones first (a sketch of the
shingles that repeat within blocks of text, at most 2^22 small numbers), then by
hash. Sets that link share a key in the list of their first common shingle (or
subset), where the sizes and positions of both bound their overlap; pairs that
cannot reach it are left out.

No group of near copies is expanded into pairs. The sets of a list are ordered by
size, and only neighbours are tested. Components of the links found tell which
lists still hold more than one component; only in those lists are pairs between
different components tested too, again with the size and position bounds. That is
exact: two linked sets share a list, and are then either in one component already
or tested themselves. A profile of each set (its shingles counted in cells, about an eighth
of a byte for each, and the parities of these counts in cells of about one shingle) excludes most
pairs that cannot reach the similarity, again exactly: a cell of unlike parity holds a shingle that
only one of two sets has. All others are verified on the full sets. In an open list the entries carry
their profiles, folded to 64 cells and 512 parities, and are compared in NumPy where the list is; only pairs that the
profiles admit become rows. A long list is cut into parts, every two of which meet in a
place of their own. First a few admitted partners of each entry are verified, which
connects most of what belongs together, then all between components that are left.

Plan. Postings move as packed blocks, dealt over buckets of the key range, and a
list with many sets in one task is tested there and goes on with one of them, so a
hot list meets in one place as a few entries a task. Texts are hashed anew in each
of the passes instead of keeping 64 bits for each shingle. What is broadcast is the
sketch and bit arrays (16 bits a value, 8 MB at most) that only spare work: entries of open
lists then meet the open keys by key range.

Edge cases. Null, empty and all-space texts have no shingles, are linked with nothing
and have their own id as component. One to four words are one shingle. A null id
is returned and counts last when a component's smallest id is chosen. Repeated
rows are linked to one another. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.arrowtext import pieces, text_udf
from trialstats.llm.components import components
from trialstats.llm.packed import KEY_BITS, by_bucket, pack, pack_sorted, short_key, summed, unpack, unpack_sorted
from trialstats.llm.shared import received, shipped, written
from trialstats.llm.words import WordHasher, distinct_by_text, mix64, shingle_hashes

ORDER_BITS = 22
#: Shingles in a block whose repeats are counted for the order, and repeats from which they are.
ORDER_BLOCK, ORDER_REPEATS = 2_000_000, 4
#: Postings that a task gathers before it sends them on, entries of one list from which a task tests it itself.
POSTING_BLOCK, HOT_LIST = 500_000, 16
BUCKET_POSTINGS = 250_000
#: Entries of a list, about, that meet those of another part in one place.
LIST_PART = 1_000
#: Cells of the folded profiles, rows of lists that a task compares at once, pairs that it holds meanwhile.
CELLS, LIST_ROWS, PAIRS_HELD = 64, 20_000, 1 << 16
#: Parities of the folded profiles, in bytes.
PARITY_BYTES = 64
#: Bits of a bit array for each value, and in all at most; with more values it only spares less work.
VALUE_BITS, BIT_ARRAY_BITS = 16, 1 << 26
#: What is verified first: open lists of a set (its rarest shingles), partners of an entry there, and of a set in all of them.
FEW_LISTS, FEW_IN_LIST, FEW_OF_SET = 4, 2, 12


@dataclass(frozen=True)
class Rule:
    """Sizes and overlaps for a similarity of ``percent``, and the largest light size."""

    percent: int = 75
    light: int = 0

    def least_overlap(self, n: np.ndarray) -> np.ndarray:
        """Overlap that a set of n shingles needs with any partner."""
        return -(-n * self.percent // 100)

    def prefix(self, n: np.ndarray, shared: int) -> np.ndarray:
        """Length of the prefix that holds ``shared`` common shingles of any linked pair."""
        return n - self.least_overlap(n) + shared

    @property
    def least_listed(self) -> int:
        """Smallest set that may link with a heavy one."""
        return -(-(self.light + 1) * self.percent // 100)

    def largest_partner(self, n: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Size up to which a partner is possible if the first common shingle is at ``position``."""
        return (100 + self.percent) * (n - position) // self.percent - n


def document_sets(hasher: WordHasher, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, offsets, sizes, set ids) of the texts; shingles distinct and ascending within each."""
    values, bounds = distinct_by_text(*shingle_hashes(hasher(data, at)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values ^ np.uint64(0x51ED270B9F1A3C47)), dtype=np.uint64)])
    n = np.diff(bounds)
    ids = mix64(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64))
    return values, bounds, n, ids.view(np.int64)


def profile(values: np.ndarray) -> bytes | None:
    """Numbers of a set's shingles by their low bits, about eight to a cell of 64 or more; None if one does not fit a byte."""
    cells = max(CELLS, 8 << max(0, (len(values) // 64 - 1).bit_length()))
    counts = np.bincount((values & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def largest_overlap(a: bytes | None, b: bytes | None) -> int | None:
    """What two sets can share at most by their profiles: the smaller number of each cell. None if unknown."""
    if a is None or b is None:
        return None
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b))
    cells = min(len(x), len(y))  # powers of two, so the cells of one fold onto those of the other
    return int(np.minimum(x.reshape(-1, cells).sum(0), y.reshape(-1, cells).sum(0)).sum())


def parities(values: np.ndarray) -> bytes:
    """Whether the number of a set's shingles is odd, by their middle bits: a bit for each of 512 cells or more, about one shingle to a cell."""
    cells = max(PARITY_BYTES * 8, 1 << max(0, len(values) - 1).bit_length())
    counts = np.bincount(((values >> np.uint64(20)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def folded(odd: bytes, size: int) -> np.ndarray:
    """The parities in ``size`` bytes, a power of two of at most their own."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.uint8).reshape(-1, size), axis=0)


def least_difference(a: bytes, b: bytes) -> int:
    """Shingles that are in one of two sets only, at least: their cells of unlike parity."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def _sets_and_repeats(texts: DataFrame, buckets: int = 64) -> DataFrame:
    """One row per document (doc_id, n, set_id), and blocks of order cells that repeat (bucket, block)."""
    out = T.StructType([texts.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("set_id", T.LongType()), T.StructField("profile", T.BinaryType()),
                        T.StructField("parity", T.BinaryType()), T.StructField("bucket", T.IntegerType()), T.StructField("block", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size, id_type = WordHasher(), [], 0, None

        def repeats() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= ORDER_REPEATS
            cells, counts = summed(short_key(keys[often]) >> np.uint64(KEY_BITS - ORDER_BITS) << np.uint64(KEY_BITS - ORDER_BITS), counts[often])
            found = [(b, pack_sorted(cells[s], counts[s])) for b, s in by_bucket(cells, buckets)]
            m = len(found)
            return pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=out.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for row, end, data, at in pieces(batch.column(1)):
                values, bounds, n, ids = document_sets(hasher, data, at)
                m = end - row
                profiles, odd = ([f(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] for f in (profile, parities))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, m), pa.array(n), pa.array(ids), pa.array(profiles, pa.binary()), pa.array(odd, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=out.names)
                held.append(values)
                size += len(values)
                if size >= ORDER_BLOCK:
                    yield repeats()
                    held, size = [], 0
        if size:
            yield repeats()

    return texts.mapInArrow(run, out)


def _order_sketch(blocks: DataFrame) -> np.ndarray:
    """Class (rounded log2 of the count) of each cell of the shingle order; at most 2^22 bytes come to the driver."""

    def add(table: pa.Table) -> pa.Table:
        parts = [unpack_sorted(b.as_py()) for b in table.column("block")]
        return pa.table({"block": pa.array([pack_sorted(*summed(*(np.concatenate(c) for c in zip(*parts))))], pa.binary())})

    sketch = np.zeros(1 << ORDER_BITS, np.uint8)
    for r in blocks.where("block is not null").groupBy("bucket").applyInArrow(add, "block binary").collect():
        cells, counts = unpack_sorted(bytes(r["block"]))
        sketch[(cells >> np.uint64(KEY_BITS - ORDER_BITS)).astype(np.int64)] = np.log2(counts.astype(float)).astype(np.uint8)
    return sketch


def choose_boundary(sizes: dict[int, int], percent: int, scan_cost: float = 4.0, most: int = 64) -> int:
    """The light size with the least cost for these numbers of sets by size (larger sizes under the largest key)."""
    rule = Rule(percent)
    n = np.array(sorted(s for s in sizes if s > 1), np.int64)
    if not len(n):
        return 0
    count = np.array([sizes[int(s)] for s in n], float)
    two, one = rule.prefix(n, 2), rule.prefix(n, 1)
    best = min((float((count * two * (two - 1) / 2)[n <= x].sum() + scan_cost * (count * one)[n >= Rule(percent, x).least_listed].sum()), x) for x in range(1, most + 1))
    return best[1]


def postings(rule: Rule, sketch: np.ndarray, values: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, position) of all light subset keys and heavy list entries of some texts' sets."""
    text = np.repeat(np.arange(len(n)), n)
    kind = sketch[(values >> np.uint64(64 - ORDER_BITS)).astype(np.int64)].astype(np.uint64)
    order = np.lexsort(((kind << np.uint64(58)) | (values >> np.uint64(6)), text))
    values = values[order]
    position = np.arange(len(values)) - np.repeat(bounds[:-1], n)
    listed = (n >= max(rule.least_listed, 2))[text] & (position < rule.prefix(n, 1)[text])
    keys, texts, positions = [short_key(mix64(values[listed]))], [text[listed]], [position[listed]]
    for size in np.unique(n[(n >= 2) & (n <= rule.light)]).tolist():
        rows = np.flatnonzero(n == size)
        own = values[bounds[rows][:, None] + np.arange(int(rule.prefix(np.array(size), 2)))]
        i, j = np.triu_indices(own.shape[1], 1)
        keys.append(short_key(mix64(own[:, i] * np.uint64(0x9E3779B97F4A7C15) + mix64(own[:, j]))).ravel())
        texts.append(np.repeat(rows, len(i)))
        positions.append(np.tile(j - 1, len(rows)))
    return np.concatenate(keys), np.concatenate(texts), np.concatenate(positions)


def neighbours(rule: Rule, key: np.ndarray, set_id: np.ndarray, n: np.ndarray, position: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Pairs of neighbours, by size, in each list: a, b, sizes, whether they may link, and the keys of their lists.

    ``more`` marks entries that stand for further sets of their list. The keys of lists of two sets are left out, as are
    pairs of such lists that cannot link: nothing else is in those lists.
    """
    order = np.lexsort((set_id, n, key))
    key, set_id, n, position, more = key[order], set_id[order], n[order], position[order], more[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (set_id[1:] != set_id[:-1])])
    of_new = np.cumsum(new) - 1
    more = np.bincount(of_new, more) > 0
    key, set_id, n, position = key[new], set_id[new], n[new], position[new]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    of = np.cumsum(first) - 1
    large = (np.bincount(of) > 2) | (np.bincount(of, more) > 0)
    i = np.flatnonzero(~first[1:])
    j = i + 1
    most = rule.largest_partner(n, position)
    may = (n[j] <= most[i]) & (n[i] <= most[j])
    keep = may | large[of[i]]
    i, j, may = i[keep], j[keep], may[keep]
    swap = set_id[i] > set_id[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    a, b, k, listed = set_id[i], set_id[j], key[i], large[of[i]]
    order = np.lexsort((k, b, a))
    a, b, k, may, listed, i, j = (x[order] for x in (a, b, k, may, listed, i, j))
    begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    any_may = np.maximum.reduceat(may, begin) if len(a) else may
    stored = np.concatenate([[0], np.cumsum(listed)])
    offsets = (stored[np.append(begin, len(a))] * 8).astype(np.int32)
    keys = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(k[listed].astype("<u8").tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(a[begin]), pa.array(b[begin]), pa.array(n[i[begin]]), pa.array(n[j[begin]]), pa.array(any_may), keys], names=["a", "b", "n_a", "n_b", "may", "keys"])


_PAIR = "a bigint, b bigint, n_a bigint, n_b bigint, may boolean, keys binary"


def _list_pairs(texts: DataFrame, rule: Rule, sketch, buckets: int) -> DataFrame:
    """Pairs of neighbours of all lists. Postings go to their bucket in packed blocks; the pairs of lists that are hot
    within a task go along as they are, in buckets below 0."""
    out = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, hasher, seen = received(sketch), WordHasher(), set()
        held: list[tuple] = []
        size = sets = 0

        def flush() -> pa.RecordBatch:
            ids, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            key, of, position = (np.concatenate([h[2][k] for h in held]) for k in range(3))
            rank = np.lexsort((ids[of], sizes[of], key))
            key, of, position = key[rank], of[rank], position[rank]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length = np.diff(first, append=len(key))
            hot = np.repeat(length >= HOT_LIST, length)
            if hot.any():
                pairs = neighbours(rule, key[hot], ids[of[hot]], sizes[of[hot]], position[hot], np.ones(int(hot.sum()), bool))
                stays = ~hot
                stays[first] = True
                key, of, position, hot = key[stays], of[stays], position[stays], hot[stays]
            else:
                pairs = None
            found = [] if pairs is None else [(-1 - int(pairs.column(0)[0].as_py()) % buckets, _written_batch(pairs))]
            for b, s in by_bucket(key, buckets):
                own, place = np.unique(of[s], return_inverse=True)
                found.append((b, pack(np.diff(key[s], prepend=np.uint64(0)), place, position[s], hot[s], ids[own].view(np.uint64), sizes[own])))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=out.names)

        for batch in batches:
            for _, _, data, at in pieces(batch.column(0)):
                values, bounds, n, ids = document_sets(hasher, data, at)
                fresh = np.array([not (i in seen or seen.add(i)) for i in ids.tolist()], bool) & (n > 1)
                keep = np.repeat(fresh, n)
                values, n, ids = values[keep], n[fresh], ids[fresh]
                if not len(n):
                    continue
                bounds = np.concatenate([[0], np.cumsum(n)])
                key, of, position = postings(rule, order, values, bounds, n)
                held.append((ids, n, (key, of + sets, position)))
                size, sets = size + len(key), sets + len(n)
                if size >= POSTING_BLOCK:
                    yield flush()
                    held, size, sets = [], 0, 0
        if size:
            yield flush()

    def chain(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in table.column("block")])
        parts = []
        for block in table.column("block"):
            steps, place, position, hot, ids, sizes = unpack(block.as_py())
            place = place.astype(np.int64)
            parts.append((np.cumsum(steps, dtype=np.uint64), ids.view(np.int64)[place], sizes.astype(np.int64)[place], position.astype(np.int64), hot > 0))
        return pa.Table.from_batches([neighbours(rule, *(np.concatenate(c) for c in zip(*parts)))])

    return texts.select("text").mapInArrow(run, out).groupBy("bucket").applyInArrow(chain, _PAIR)


def _written_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def bit_array(values: DataFrame, column: str, n: int) -> np.ndarray:
    """Bits, eight to a byte, of about n values' lowest bits; a value whose bit is not set is surely absent."""
    bits = min(BIT_ARRAY_BITS, 1 << max(12, (VALUE_BITS * n - 1).bit_length()))
    cell = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (values.select(F.shiftright(cell, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(bits // 64, "<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the values (unsigned) may be among those of the bit array."""
    cell = (values & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def _members(texts: DataFrame, by_set: DataFrame, ids: DataFrame) -> DataFrame:
    """(set_id, members): the full sets of some ids, each from (at least) the document with its smallest id.

    Only texts whose document may be wanted, by a bit array over hashes of document ids, are hashed.
    """
    wanted_docs = by_set.join(ids, "set_id", "left_semi").select(F.xxhash64("least_id").alias("hash"))
    wanted = shipped(texts.sparkSession, bit_array(wanted_docs, "hash", ids.count()))
    out = T.StructType([T.StructField("set_id", T.LongType()), T.StructField("members", T.ArrayType(T.LongType()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hasher, seen = received(wanted), WordHasher(), set()
        for batch in batches:
            chosen = batch.column(1).filter(pa.array(may_hold(bits, batch.column(0).to_numpy().view(np.uint64))))
            for _, _, data, at in pieces(chosen):
                values, bounds, _, ids = document_sets(hasher, data, at)
                new = [i for i, s in enumerate(ids.tolist()) if not (s in seen or seen.add(s))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array([values[bounds[i]:bounds[i + 1]].view(np.int64) for i in new], pa.list_(pa.int64()))], names=out.names)

    return texts.select(F.xxhash64("doc_id"), "text").mapInArrow(sets, out).join(ids, "set_id", "left_semi")


def _possible(pairs: DataFrame, by_set: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sets' profiles do not exclude."""
    left = by_set.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("profile").alias("x"), F.col("parity").alias("odd_x"))
    right = by_set.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("profile").alias("y"), F.col("parity").alias("odd_y"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            most = [largest_overlap(x, y) for x, y in zip(c["x"], c["y"])]
            apart = [least_difference(x, y) for x, y in zip(c["odd_x"], c["odd_y"])]
            good = [(m is None or (100 + percent) * m >= percent * (i + j)) and (100 + percent) * (i + j - d) >= 2 * percent * (i + j)
                    for m, d, i, j in zip(most, apart, c["n_a"], c["n_b"])]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y", "odd_x", "odd_y")
    return both.mapInArrow(test, "a bigint, b bigint")


def _verified(texts: DataFrame, by_set: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b of set ids) whose full sets reach the similarity."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "pair-ids")
    sets = _members(texts, by_set, ids).dropDuplicates(["set_id"])
    left = sets.select(F.col("set_id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("members").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    enough = (100 + percent) * shared >= percent * (F.size("x") + F.size("y"))
    return written(pairs.select("a", "b").join(left, "a").join(right, "b").where(enough).select("a", "b"), "verified")


def _open_keys(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Keys of the lists that hold neighbours of different components."""
    apart = _apart(pairs.where("length(keys) > 0"), labels).select("keys")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(k.as_py(), "<i8") for k in batch.column(0)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["key"])

    return written(apart.mapInArrow(keys, "key bigint").distinct(), "open-keys")


def _open_entries(texts: DataFrame, rule: Rule, sketch, open_keys: DataFrame, buckets: int) -> DataFrame:
    """(key, id, n, most) of all entries of the open lists; most is the largest size of a partner.

    Entries that the bit array does not exclude move in packed blocks to the open keys of their bucket, and only those in
    open lists become rows. A block is handled alone, after the keys of its bucket.
    """
    wanted = shipped(texts.sparkSession, bit_array(open_keys, "key", open_keys.count()))
    out = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("entries", T.BooleanType()), T.StructField("block", T.BinaryType())])

    def blocks(found: list[tuple[int, bytes]], entries: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([entries] * len(found), pa.bool_()), pa.array([x for _, x in found], pa.binary())], names=out.names)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.sort(batch.column(0).to_numpy().view(np.uint64))
            yield blocks([(b, pack_sorted(own[s])) for b, s in by_bucket(own, buckets)], False)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bits, hasher, seen = received(sketch), received(wanted), WordHasher(), set()
        held: list[tuple] = []
        size = sets = 0

        def flush() -> pa.RecordBatch:
            ids, sizes, key, of, position = (np.concatenate(c) for c in zip(*held))
            rank = np.argsort(key, kind="stable")
            key, of, position = key[rank], of[rank], position[rank]
            found = []
            for b, s in by_bucket(key, buckets):
                own, place = np.unique(of[s], return_inverse=True)
                found.append((b, pack_sorted(key[s], place, position[s], ids[own].view(np.uint64), sizes[own])))
            return blocks(found, True)

        for batch in batches:
            for _, _, data, at in pieces(batch.column(0)):
                values, bounds, n, ids = document_sets(hasher, data, at)
                fresh = np.array([not (i in seen or seen.add(i)) for i in ids.tolist()], bool)
                key, of, position = postings(rule, order, values, bounds, n)
                hit = may_hold(bits, key) & fresh[of]
                own, of = np.unique(of[hit], return_inverse=True)
                held.append((ids[own], n[own], key[hit], of + sets, position[hit]))
                size, sets = size + len(of), sets + len(own)
                if size >= POSTING_BLOCK:
                    yield flush()
                    held, size, sets = [], 0, 0
        if size:
            yield flush()

    def of_open_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = -1, []
        for batch in batches:
            for b, is_entries, block in zip(*batch.columns):
                if b.as_py() != bucket:
                    bucket, held = b.as_py(), []
                if not is_entries.as_py():
                    held.append(unpack_sorted(block.as_py())[0])
                    continue
                if len(held) != 1:
                    held = [np.sort(np.concatenate(held or [np.zeros(0, np.uint64)]))]
                key, place, position, ids, n = unpack_sorted(block.as_py())
                at = np.searchsorted(held[0], key)
                hit = np.flatnonzero(at < len(held[0]))
                hit = hit[held[0][at[hit]] == key[hit]]
                own = place[hit].astype(np.int64)
                n = n.astype(np.int64)[own]
                yield pa.RecordBatch.from_arrays([pa.array(key[hit].view(np.int64)), pa.array(ids.view(np.int64)[own]), pa.array(n), pa.array(rule.largest_partner(n, position[hit].astype(np.int64)))],
                                                 names=["key", "id", "n", "most"])

    dealt = open_keys.mapInArrow(keys, out).unionAll(texts.select("text").mapInArrow(entries, out)).repartition("bucket").sortWithinPartitions("bucket", "entries")
    return written(dealt.mapInArrow(of_open_lists, "key bigint, id bigint, n bigint, most bigint").dropDuplicates(["key", "id"]), "open-entries")


def _still_open(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries, with their components, of lists that hold more than one."""
    labelled = written(entries.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    return written(labelled.join(open_keys, "key", "left_semi"), "still-open")


def _folded(by_set: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, cells, odd): the profiles of some sets in 64 cells of a byte, null if one does not fit, and in 512 parities."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [None if p is None else np.frombuffer(p, np.uint8).reshape(-1, CELLS).sum(0, dtype=np.int64) for p in batch.column(1).to_pylist()]
            cells = [None if c is None or c.max() > 255 else c.astype(np.uint8).tobytes() for c in sums]
            odd = [folded(p, PARITY_BYTES).tobytes() for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary()), pa.array(odd, pa.binary())], names=["id", "cells", "odd"])

    wanted = by_set.join(ids, by_set["set_id"] == ids["id"], "left_semi").select(F.col("set_id").alias("id"), "profile", "parity")
    return wanted.mapInArrow(fold, "id bigint, cells binary, odd binary")


def admitted_pairs(lists: pa.Table, percent: int, few: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b; a < b) of entries that meet in one place, of different components, and that no bound excludes.

    The rows of one place (key, lo, hi) lie together; their parities (``odd``) may be left out. ``few``: at most so many partners of each entry among those after it.
    """
    key, lo, hi, part, ids, n, most, component = (lists.column(c).to_numpy() for c in ("key", "lo", "hi", "part", "id", "n", "most", "component"))
    folded = lists.column("cells").to_pylist()
    known = np.array([c is not None for c in folded], bool)
    cells = np.frombuffer(b"".join(bytes(CELLS) if c is None else c for c in folded), np.uint8).reshape(-1, CELLS)
    odd = np.frombuffer(b"".join(lists.column("odd").to_pylist()), np.uint64).reshape(len(key), -1) if "odd" in lists.column_names else None
    rows = len(key)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
    end = np.repeat(np.append(first[1:], rows), np.diff(first, append=rows))
    after = end - np.arange(rows) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    row = 0
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(total, total[row] + PAIRS_HELD, side="right")) - 1)
        i = np.repeat(np.arange(row, stop), after[row:stop])
        j = i + 1 + np.arange(len(i)) - (total[i] - total[row])
        fits = (component[i] != component[j]) & (n[i] <= most[j]) & (n[j] <= most[i]) & ((lo[i] == hi[i]) | (part[i] != part[j]))
        i, j = i[fits], j[fits]
        if odd is not None:
            both = n[i] + n[j]
            fits = (100 + percent) * (both - np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64)) >= 2 * percent * both
            i, j = i[fits], j[fits]
        overlap = np.where(known[i] & known[j], np.minimum(cells[i], cells[j]).sum(1, dtype=np.int64), np.minimum(n[i], n[j]))
        fits = (100 + percent) * overlap >= percent * (n[i] + n[j])
        i, j = i[fits], j[fits]
        if few is not None and len(i):
            order = np.lexsort((mix64((ids[i] ^ ids[j]).view(np.uint64)), i))
            i, j = i[order], j[order]
            start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            chosen = np.arange(len(i)) - np.repeat(start, np.diff(start, append=len(i))) < few
            i, j = i[chosen], j[chosen]
        if len(i):
            yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        row = stop


def _admitted(entries: DataFrame, by_set: DataFrame, percent: int, few: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) of different components that open lists admit; all of them, or a few of each entry."""
    with_cells = entries.join(_folded(by_set, entries.select("id").distinct()), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(h) for h in held) < LIST_ROWS:
                continue
            table = pa.Table.from_batches(held)
            place = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
            last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in place], axis=0))  # the last place may go on in the next batch
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from _pair_batches(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from _pair_batches(pa.Table.from_batches(held))

    def _pair_batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(table):
            for a, b in admitted_pairs(table, percent, few):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = _meeting_parts(with_cells, "component", "cells", "odd").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, scan_cost: float = 4.0) -> DataFrame:
    """Per row: doc_id, n_shingles, set_id, component_id (smallest id reachable by links, its own included)."""
    rows, _, named = _components(docs, id_col, text_col, percent, scan_cost)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(named, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "set_id", own.alias("component_id"))


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, scan_cost: float = 4.0) -> DataFrame:
    """Rows of ``docs``, all columns, without those that link to a row with a smaller id; one of repeated rows stays.

    Rows without shingles stay. The texts are shuffled once, by their set, for the join with the one set of each
    component that stays; only sets with repeated rows of the staying id need more.
    """
    rows, by_set, named = _components(docs, id_col, text_col, percent, scan_cost)
    of_set = by_set.select("set_id", "least_id").join(named, "set_id")
    stays = of_set.where(F.col("least_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("set_id").alias("set_id"), F.first("component_id").alias("stay_id"))
    times = rows.join(stays, "set_id").where(F.col("doc_id").eqNullSafe(F.col("stay_id"))).groupBy("set_id").agg(F.count("*").alias("times"))
    own, stay_set, stay_id = (_unused(docs, name) for name in ("_llm_set", "_llm_stay_set", "_llm_stay_id"))
    stays = written(stays.join(times, "set_id").select(F.col("set_id").alias(stay_set), F.col("stay_id").alias(stay_id), "times"), "jaccard-stays")
    marked = _with_set(docs, text_col, own)
    chosen = [marked.join(stays.where(where).drop("times"), (F.col(own) == F.col(stay_set)) & F.col(id_col).eqNullSafe(F.col(stay_id)))
              for where in ("times = 1", "times > 1")]
    empty = marked.where(F.col(own).isNull())
    return reduce(DataFrame.unionAll, [x.select(docs.columns) for x in (chosen[0], chosen[1].dropDuplicates([own]), empty)])


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _with_set(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with its set id as ``name``; null without shingles.

    Declared nondeterministic, so that a filter on the id does not make Spark hash the texts twice, in two more Python workers.
    """

    def make():
        hasher = WordHasher()

        def set_ids(texts: pa.Array) -> pa.Array:
            parts = [document_sets(hasher, data, bounds)[2:] for _, _, data, bounds in pieces(texts)]
            n, ids = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
            return pa.array(ids, pa.int64(), mask=n == 0)

        return set_ids

    return docs.withColumn(name, text_udf(make, "bigint").asNondeterministic()(F.col(text_col).cast("string")))


def link_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, scan_cost: float = 4.0) -> DataFrame:
    """Per row: doc_id, n_shingles, n_links (other rows it links with, those of an equal set included).

    Unlike the components this needs every link, so all pairs of distinct sets that the bounds allow are verified; the
    cost grows with the number of links.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = written(_sets_and_repeats(texts), "jaccard-sets")
    by_set = (first.where("n > 0").groupBy("set_id")
              .agg(F.first("n").alias("n"), F.min("doc_id").alias("least_id"), F.max("profile").alias("profile"), F.max("parity").alias("parity"), F.count("*").alias("times")))
    by_set = written(by_set, "jaccard-distinct")
    links = all_links(texts, by_set, _order_sketch(first), percent, scan_cost)
    times = by_set.select(F.col("set_id").alias("b"), "times")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(times, "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("times").alias("others"))
    of_set = by_set.join(others, "set_id", "left").select("set_id", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    rows = first.where("n is not null").select("doc_id", "n", "set_id")
    return rows.join(of_set, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def all_links(texts: DataFrame, by_set: DataFrame, order: np.ndarray, percent: int, scan_cost: float) -> DataFrame:
    """All verified links (a, b of set ids; a < b) between distinct sets."""
    rule, _ = _rule(by_set, percent, scan_cost)
    entries = _entries(texts, rule, shipped(texts.sparkSession, order))
    pairs = written(_possible(_pairs_in_parts(entries), by_set, percent), "all-pairs")
    return _verified(texts, by_set, pairs, percent)


def _meeting_parts(entries: DataFrame, *more: str) -> DataFrame:
    """(key, lo, hi, part, id, n, most, ``more``): the entries once for each place where their part of the list meets another."""
    counts = entries.groupBy("key").agg(F.ceil(F.count("*") / LIST_PART).alias("parts")).where("parts > 1")
    own = entries.join(counts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    other = own.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    return other.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "n", "most", *more)


def _pairs_in_parts(entries: DataFrame) -> DataFrame:
    """All pairs in the lists within the size and position bounds."""
    dealt = written(_meeting_parts(entries), "list-parts")
    x, y = dealt.alias("x"), dealt.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "lo", "hi")]
    fits = (F.col("x.id") < F.col("y.id")) & (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most")) & ((F.col("x.lo") == F.col("x.hi")) | (F.col("x.part") != F.col("y.part")))
    return x.join(y, reduce(Column.__and__, on) & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _entries(texts: DataFrame, rule: Rule, sketch) -> DataFrame:
    """(key, id, n, most) of all entries of all lists; most is the largest size of a partner."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, hasher = received(sketch), WordHasher()
        for batch in batches:
            for _, _, data, at in pieces(batch.column(0)):
                values, bounds, n, ids = document_sets(hasher, data, at)
                key, of, position = postings(rule, order, values, bounds, n)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ids[of]), pa.array(n[of].astype(np.int64)), pa.array(rule.largest_partner(n[of], position))], names=["key", "id", "n", "most"])

    found = texts.select("text").mapInArrow(entries, "key bigint, id bigint, n bigint, most bigint")
    return written(found.groupBy("key", "id", "n").agg(F.max("most").alias("most")), "entries")


def _rule(by_set: DataFrame, percent: int, scan_cost: float) -> tuple[Rule, int]:
    """The rule with the best boundary, and the number of list entries."""
    sizes = {r["n"]: r["count"] for r in by_set.groupBy(F.least("n", F.lit(4096)).alias("n")).count().collect()}
    rule = Rule(percent, choose_boundary(sizes, percent, scan_cost))
    n = np.array(list(sizes), np.int64)
    return rule, int((np.array(list(sizes.values())) * rule.prefix(n, 1)).sum()) if len(n) else 0


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int, scan_cost: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, set_id) by row, (set_id, n, least_id) by set, (set_id, component, component_id) by set."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = written(_sets_and_repeats(texts), "jaccard-sets")
    rows = first.where("n is not null").select("doc_id", "n", "set_id")
    by_set = (first.where("n > 0").groupBy("set_id")
              .agg(F.first("n").alias("n"), F.min("doc_id").alias("least_id"), F.max("profile").alias("profile"), F.max("parity").alias("parity")))
    by_set = written(by_set, "jaccard-distinct")
    links = links_of_sets(texts, by_set, _order_sketch(first), percent, scan_cost)
    labels = components(links)
    of_set = by_set.drop("profile", "parity").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    of_set = written(of_set, "jaccard-labelled")
    least = written(of_set.groupBy("component").agg(F.min("least_id").alias("component_id")), "jaccard-least")
    return rows, by_set, written(of_set.join(least, "component").select("set_id", "component", "component_id"), "jaccard-components")


def links_of_sets(texts: DataFrame, by_set: DataFrame, order: np.ndarray, percent: int, scan_cost: float) -> DataFrame:
    """Verified links (a, b of set ids) that connect all linked sets: their components are those of all links."""
    rule, total = _rule(by_set, percent, scan_cost)
    sketch = shipped(texts.sparkSession, order)
    buckets = max(8, -(-total // BUCKET_POSTINGS))
    pairs = written(_list_pairs(texts, rule, sketch, buckets), "pairs")
    tested = written(_possible(pairs.where("may").select("a", "b").distinct(), by_set, percent), "tested")
    links = _connecting_links(texts, by_set, tested, percent)
    labels = components(links, rounds=2)
    open_keys = _open_keys(pairs, labels)
    if open_keys.isEmpty():
        return links
    entries = _open_entries(texts, rule, sketch, open_keys, buckets)
    # a few partners of each join most of what belongs together, so that few pairs are left
    rarest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("most"), "key"))
    some = written(_still_open(entries, labels).withColumn("rank", rarest).where(F.col("rank") <= FEW_LISTS).drop("rank"), "some-entries")
    found = _admitted(some, by_set, percent, FEW_IN_LIST).join(tested, ["a", "b"], "left_anti")
    found = written(_possible(found, by_set, percent), "found")
    chosen = written(_few_of_each(found, FEW_OF_SET), "chosen")
    links = links.unionAll(_verified(texts, by_set, chosen, percent))
    left = _admitted(_still_open(entries, components(links, rounds=2)), by_set, percent)
    left = left.join(tested.unionAll(chosen), ["a", "b"], "left_anti")
    left = written(_possible(left, by_set, percent), "left")
    return links if left.isEmpty() else links.unionAll(_connecting_links(texts, by_set, left, percent))


def _few_of_each(pairs: DataFrame, each: int = 3) -> DataFrame:
    """The ``each`` pairs of every set with the smallest hashes."""
    both = pairs.select("a", "b", F.col("a").alias("node")).unionAll(pairs.select("a", "b", F.col("b").alias("node")))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("a", "b"), "a", "b"))
    return both.withColumn("rank", rank).where(F.col("rank") <= each).select("a", "b").distinct()


def _connecting_links(texts: DataFrame, by_set: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Verified links with the components of all links among ``pairs``, without verifying all of them.

    First a few pairs of every set, which connect most of a group, then of the others those between different components.
    """
    first = written(_few_of_each(pairs), "first-pairs")
    links = _verified(texts, by_set, first, percent)
    others = written(pairs.join(first, ["a", "b"], "left_anti"), "other-pairs")
    if others.isEmpty():
        return links
    rest = written(_apart(others, components(links, rounds=2)).select("a", "b"), "rest-pairs")
    return links if rest.isEmpty() else links.unionAll(_verified(texts, by_set, rest, percent))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose sets are in different components."""
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("c_a"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("c_b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
