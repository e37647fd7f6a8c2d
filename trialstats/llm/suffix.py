"""Removal of long byte strings that occur more than once, by suffix arrays over shards.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else
too, in the same text or another one. Strings do not cross texts, and are judged on the
input, not on what is left.

1. *Anchors.* Each window of ``length`` bytes is owned by the smallest hash of its ``GRAM``-byte
   grams, which depends on nothing but the window. Consecutive windows with one owner are an
   anchor; the bytes they cover are its piece. Equal windows have equal owners, so an owner with a
   single anchor in the whole corpus, which owns by one and the same gram, owns no repeated
   window, and where all anchors of an owner have one piece, all their windows repeat. Only
   pieces of owners with unlike pieces, or owned by several equal grams (as in periodic text), go
   on, and equal pieces go on as one with a count.
2. *Shards.* An owner's pieces go to one shard, those of an owner above a shard's size to several (salts).
   A shard sorts the suffixes of its pieces by Larsson-Sadakane refinement (groups of equal
   prefixes are sorted by the rank half as far on; only groups not yet single are sorted again),
   up to ``length`` bytes. The common prefixes of neighbours follow by Kasai's rule along
   runs of positions whose neighbours run along with them. A window whose neighbour shares
   ``length`` bytes is repeated.
3. *Merging.* Shards that share an owner deal their distinct windows, as sorted 128-bit
   digests, to ranges; in a range each window that is single in its shard is looked up among
   those of the other shards by binary search.
4. *Cutting.* The repeated windows of each text are joined with the text, merged to
   spans, and cut out.

Plan. Texts are read by a scan for the anchors, and moved once, to the anchors of the texts
that have owners with several anchors; these texts are written. All joins are on keys whose other
side has one row a key, so a hot text or piece is split by AQE on its own side. A shard holds
about ``shard_bytes`` of pieces; long texts are cut into blocks for the anchors.

Edge cases. Null counts as empty; texts shorter than ``length`` stay whole. Repeated
rows are texts like any others: their bytes occur elsewhere. Null ids are returned as
they are, empty tables give no rows, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.llm.arrowtext import PIECE_BYTES, pieces
from trialstats.llm.shared import written
from trialstats.llm.words import mix64

LENGTH = 400
GRAM = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_AT_BITS = np.uint64(21)  # positions in a block


# ---------------------------------------------------------------- anchors

class Owners:
    """Owners of the windows of a run of texts."""

    def __init__(self, length: int) -> None:
        self.length, self.gram = length, max(1, min(GRAM, length // 2))
        n = PIECE_BYTES + length + 1
        self._byte = mix64(np.arange(1, 257, dtype=np.uint64))
        self._power, self._inverse = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The owner of the window from each byte on, and the first gram with its hash; the caller leaves out windows that leave a text."""
        n, k, wide = len(data), self.gram, self.length - self.gram + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self._byte[data] * self._power[:n], out=total[1:])
        grams = mix64((total[k:] - total[:-k]) * self._inverse[:n + 1 - k])
        # smallest of each ``wide`` grams, the first of equal ones: suffix minima of one block, prefix minima of the next
        m = len(grams)
        ranked = (grams >> _AT_BITS << _AT_BITS) | np.arange(m, dtype=np.uint64)
        blocks = np.concatenate([ranked, np.full(-m % wide, _LAST)]).reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:m - wide + 1], ahead[wide - 1:m]) & ((np.uint64(1) << _AT_BITS) - np.uint64(1))
        return grams[least], least


def _blocks(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset of the first byte in its text, bytes, offsets); long texts in blocks that share length - 1 bytes."""
    for row, _, data, at in pieces(column):
        if len(at) == 2:
            for start in range(0, max(len(data) - length + 1, 0), PIECE_BYTES):
                part = data[start:start + PIECE_BYTES + length - 1]
                yield row, start, part, np.array([0, len(part)])
        else:
            yield row, 0, data, at


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """(owner, piece, key, lo, hi, several): the windows lo..hi of text ``key`` with one owner, a digest of the bytes they cover, and whether
    several equal grams own them. texts: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = Owners(length)
        for batch in batches:
            for row, offset, data, at in _blocks(batch.column(1), length):
                if len(data) < length:
                    continue
                owner, gram = owners(data)
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(owner)]
                window = np.flatnonzero(np.arange(len(owner)) + length <= at[1:][text])
                if not len(window):
                    continue
                own, of = owner[window], text[window]
                first = np.ones(len(window), bool)
                first[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
                starts = np.flatnonzero(first)
                lo, hi = window[starts], window[np.append(starts[1:], len(window)) - 1]
                several = gram[lo] != gram[hi]
                raw = data.tobytes()
                digest = b"".join(hashlib.blake2b(raw[a:b + length], digest_size=8).digest() for a, b in zip(lo.tolist(), hi.tolist()))
                base = at[of[starts]] - offset
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[starts].view(np.int64)), pa.array(np.frombuffer(digest, np.int64)), batch.column(0).take(pa.array(row + of[starts])),
                     pa.array(lo - base, pa.int64()), pa.array(hi - base, pa.int64()), pa.array(several)], names=["owner", "piece", "key", "lo", "hi", "several"])

    return texts.mapInArrow(run, "owner long, piece long, key binary, lo long, hi long, several boolean")


# ---------------------------------------------------------------- suffix arrays of a shard

def suffix_array(data: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` bytes (Larsson-Sadakane refinement in NumPy).

    ``room``: bytes from each position to the end of its piece. A suffix that ends within the bytes compared
    so far is unlike all others; its place among them is left open.
    """
    n, h = len(data), min(8, depth)
    whole = np.flatnonzero(room >= h)
    head = _heads(data)[whole] >> np.uint64(64 - 8 * h)
    order = np.argsort(head, kind="stable")
    head = head[order]
    sa = np.concatenate([whole[order], np.flatnonzero(room < h)])
    new = np.ones(n, bool)
    new[1:len(whole)] = head[1:] != head[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = _unsorted(new)
    while h < depth and len(slots):
        deeper = min(2 * h, depth)
        at = sa[slots]
        short = room[at] < deeper
        second = np.where(short, n + at, rank[np.where(short, at, at + deeper - h)])
        both = rank[at] * (2 * n) + second
        order = np.argsort(both, kind="stable")
        at, both = at[order], both[order]
        sa[slots] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = both[1:] != both[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        slots = slots[_unsorted(fresh)]
        h = deeper
    return sa


def _heads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def _unsorted(new: np.ndarray) -> np.ndarray:
    """Indexes in groups of two or more; ``new`` marks the first of each group."""
    last = np.append(new[1:], True)
    return np.flatnonzero(~(new & last))


def neighbour_prefixes(data: np.ndarray, room: np.ndarray, sa: np.ndarray, owned: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, its neighbour, bytes in common up to ``depth``) of owned positions and the owned position before each in suffix order.

    Kasai's rule: where position i and its neighbour both follow the position and neighbour
    of i - 1, they share one byte less; elsewhere the bytes are compared.
    """
    order = sa[owned[sa]]
    before = np.full(len(data) + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before[:-1] >= 0)
    to = before[at]
    follows = np.zeros(len(at), bool)
    follows[1:] = (at[1:] == at[:-1] + 1) & (to[1:] == to[:-1] + 1) & (room[at[1:]] == room[at[:-1]] - 1) & (room[to[1:]] == room[to[:-1]] - 1)
    head = _heads(data)
    common = np.zeros(len(at), np.int64)
    todo = np.flatnonzero(~follows)
    while len(todo):
        starts = np.flatnonzero(~follows)
        reach = np.diff(np.append(starts, len(at)))[np.searchsorted(starts, todo)] + depth  # more is of no use to those that follow
        common[todo] = _compare(head, room, at[todo], to[todo], reach)
        start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
        common = np.maximum(common[start] - (np.arange(len(at)) - start), 0)
        todo = np.flatnonzero(follows & (common <= 0))  # nothing follows from a common part that has ended
        follows[todo] = False
    return at, to, np.minimum(common, depth)


def _compare(head: np.ndarray, room: np.ndarray, a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    most = np.minimum(np.minimum(room[a], room[b]), reach)
    going = np.arange(len(a))
    while len(going):
        x, y = a[going] + out[going], b[going] + out[going]
        differ = head[x] ^ head[y]
        high, low = (differ >> np.uint64(32)).astype(np.float64), (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
        bits = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])  # 32 bits are exact as floats
        same = (64 - bits) // 8
        out[going] = np.minimum(out[going] + same, most[going])
        going = going[(same == 8) & (out[going] < most[going])]
    return out


def _solve_shard(owner: np.ndarray, salts: np.ndarray, piece: np.ndarray, count: np.ndarray, column: pa.Array, length: int):
    """Of a shard's distinct pieces: repeated window ranges, and the sorted digests, with places, of distinct windows of owners that are in other shards too."""
    parts = [np.frombuffer(x, np.uint8) for x in (b.as_buffer() for b in column)]
    sizes = np.array([len(x) for x in parts], np.int64)
    ends = np.cumsum(sizes)
    data = np.concatenate(parts)
    of = np.repeat(np.arange(len(parts)), sizes)
    room = ends[of] - np.arange(len(data))
    owned = room >= length
    at, to, common = neighbour_prefixes(data, room, suffix_array(data, room, length), owned, length)
    twice = common >= length
    repeated = owned & (count[of] >= 2)
    repeated[at[twice]] = True
    repeated[to[twice]] = True
    # one window of each class of equal ones: that whose neighbour before it is unlike
    single = owned & (salts[of] > 1)
    single[at[twice]] = False
    reps = np.flatnonzero(single)
    raw = data.tobytes()
    digests = np.frombuffer(b"".join(hashlib.blake2b(raw[i:i + length], digest_size=16).digest() for i in reps.tolist()), "S16")
    order = np.argsort(digests)
    reps, digests = reps[order], digests[order]
    edge = repeated.copy()
    edge[1:] &= ~repeated[:-1] | (of[1:] != of[:-1])
    last = repeated.copy()
    last[:-1] &= ~repeated[1:] | (of[1:] != of[:-1])
    lo, hi = np.flatnonzero(edge), np.flatnonzero(last)
    start = ends - sizes
    spans = (owner[of[lo]], piece[of[lo]], lo - start[of[lo]], hi - start[of[lo]])
    open_ = ~repeated[reps]
    classes = (owner[of[reps]], piece[of[reps]], np.where(open_, reps - start[of[reps]], -1), digests)
    return spans, classes


_PLACE = "owner long, piece long, lo long, hi long"


def shard_windows(distinct: DataFrame, shards: int, shard_bytes: int, length: int) -> DataFrame:
    """Rows of two kinds: repeated windows lo..hi of a piece (range null); and, a row for each range of digests, the sorted digests of
    distinct windows of salted owners with owners, pieces and places (-1 where the window repeats in its own shard) as packed numbers."""
    salts = F.ceil(F.col("weight") / F.lit(shard_bytes)).cast("long")
    dealt = distinct.withColumn("salts", salts).withColumn(
        "shard", F.pmod(F.xxhash64("owner", F.pmod("piece", "salts")), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        num = {c: table.column(c).to_numpy() for c in ("owner", "salts", "piece", "n")}
        text = table.column("bytes").combine_chunks()
        spans, classes = _solve_shard(num["owner"], num["salts"], num["piece"], num["n"], text, length)
        digests = classes[3]
        heads = np.frombuffer(digests.tobytes(), ">u4")[::4].astype(np.uint64)
        of = (heads * np.uint64(shards)) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(of, prepend=np.uint64(shards)))
        parts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(of)])]
        n, k = len(spans[0]), len(parts)
        none = [None] * n
        packed = [pa.array(none + [c[p].tobytes() for p in parts], pa.binary()) for c in (*(x.astype(np.int64) for x in classes[:3]), digests)]
        return pa.table([*(pa.array([*c.tolist(), *[None] * k], pa.int64()) for c in spans), pa.array(none + of[starts].tolist(), pa.int64()), *packed],
                        names=["owner", "piece", "lo", "hi", "range", "owners", "pieces", "places", "digests"])

    return dealt.select("owner", "salts", "piece", "n", "bytes", "shard").groupBy("shard").applyInArrow(
        run, _PLACE + ", range long, owners binary, pieces binary, places binary, digests binary")


def merged_windows(found: DataFrame) -> DataFrame:
    """(owner, piece, lo, hi) of windows that are single in their own shard and occur in another one. found: ``shard_windows``."""

    def run(table: pa.Table) -> pa.Table:
        owner, piece, place = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("owners", "pieces", "places"))
        digest = np.frombuffer(b"".join(table.column("digests").to_pylist()), "S16")
        ordered = np.sort(digest)
        alone = np.flatnonzero(place >= 0)
        seen = np.searchsorted(ordered, digest[alone], "right") - np.searchsorted(ordered, digest[alone], "left")
        hit = alone[seen >= 2]
        return pa.table([pa.array(c[hit]) for c in (owner, piece, place, place)], names=["owner", "piece", "lo", "hi"])

    classes = found.where("range IS NOT NULL").select("range", "owners", "pieces", "places", "digests")
    return classes.groupBy("range").applyInArrow(run, _PLACE)


# ---------------------------------------------------------------- the operator

@dataclass
class Repeats:
    """``rows``: id, key, n_bytes and sha256 of each document; ``texts``: key, text of the texts that may hold repeats; ``windows``: key,
    spans (array of first and last window) of the repeated windows of each text. A key is the MD5 of a text."""

    rows: DataFrame
    texts: DataFrame
    windows: DataFrame


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = 1 << 19) -> Repeats:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    key = F.unhex(F.md5("text")).alias("key")
    rows = docs.select("id", key, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    long = docs.where(F.octet_length("text") >= length).select(key, "text")

    every = anchors(long, length)
    size = F.col("hi") - F.col("lo") + length
    unlike = (F.min("piece") != F.max("piece")) | F.max("several")
    owners = every.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("weight"), unlike.alias("mixed")).where("n > 1 OR mixed").drop("n")
    of_text = every.join(owners, "owner").groupBy("key").agg(F.collect_set(F.struct("owner", "piece", "lo", "hi", "weight", "mixed")).alias("anchors"))
    of_text = written(of_text, "anchors")
    texts = written(long.join(of_text, "key"), "repeat-texts")

    mixed = F.filter("anchors", lambda a: a["mixed"])
    total = of_text.select(F.aggregate(mixed, F.lit(0).cast("long"), lambda s, a: s + a["hi"] - a["lo"] + length).alias("n")).agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    each = texts.select("text", F.explode(mixed).alias("a"))
    each = each.select("a.owner", "a.piece", "a.weight", F.substring("text", F.col("a.lo").cast("int") + 1, (F.col("a.hi") - F.col("a.lo") + length).cast("int")).alias("bytes"))
    distinct = each.groupBy("owner", "piece", "weight").agg(F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"))
    found = written(shard_windows(distinct, shards, shard_bytes, length), "shard-windows")
    repeated = found.where("range IS NULL").select("owner", "piece", "lo", "hi").unionAll(merged_windows(found))

    placed = of_text.select("key", F.explode("anchors").alias("a")).select("key", "a.*")
    whole = placed.where("NOT mixed").select("key", "lo", "hi")
    part = placed.where("mixed").select("key", "owner", "piece", F.col("lo").alias("base")).join(repeated, ["owner", "piece"])
    part = part.select("key", (F.col("base") + F.col("lo")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi"))
    windows = whole.unionAll(part).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("windows"))
    return Repeats(rows, texts.select("key", "text"), windows)


def cut_texts(found: Repeats, length: int = LENGTH) -> DataFrame:
    """key, n_removed, n_spans (maximal removed runs) and kept (the bytes left) of each text with repeats; one row for each of its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, windows = batch.columns
            bounds = np.asarray(windows.offsets)
            both = windows.flatten()
            lo, end = both.field(0).to_numpy(), both.field(1).to_numpy() + length
            removed, spans, kept = [], [], []
            at0 = bounds[0]
            for i, text in enumerate(texts):
                raw, at, out, n = text.as_py(), 0, [], 0
                own = slice(bounds[i] - at0, bounds[i + 1] - at0)
                a, b = lo[own], np.maximum.accumulate(end[own])
                first = np.ones(len(a), bool)
                first[1:] = a[1:] > b[:-1]
                starts = np.flatnonzero(first)
                for s, e in zip(a[starts].tolist(), b[np.append(starts[1:], len(a)) - 1].tolist()):
                    out.append(raw[at:s])
                    n, at = n + e - s, e
                out.append(raw[at:])
                removed.append(n)
                spans.append(len(starts))
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([keys, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["key", "n_removed", "n_spans", "kept"])

    return found.texts.join(found.windows, "key").mapInArrow(run, "key binary, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    found = find_repeats(docs, **options)
    cut = cut_texts(found, options.get("length", LENGTH))
    cut = cut.select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["key"])
    zero = F.lit(0).cast("long")
    return found.rows.join(cut, "key", "left").select(
        "id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
