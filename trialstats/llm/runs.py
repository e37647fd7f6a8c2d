"""Periodic run detection: stretches of words that repeat with a period, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period q and at least
max(``least``, 2 q) words that no neighbouring word extends with period q.

1. *Where to look.* A run of at least ``least`` words with period q holds the same
   ``least / 2`` words at a distance of q, so every word of it lies in a window of that
   many words that the text holds twice. Only the stretches of such windows are parsed;
   a text without any has no run. This is exact, whatever the hashes do: a hash that
   collides only makes a stretch longer.
2. *Grammar.* The word ids of all stretches of a batch are compressed by Re-Pair: in each
   round every stretch replaces its most frequent pair of symbols, and the other pairs
   of the same count that do not touch it (one order of breaking the ties). The symbols
   that are left are joined in twos until one is left.
3. *Runs of a nonterminal.* A nonterminal X = A B is the text of its first occurrence. The
   runs that cross the boundary of A and B are found once: for each period the common
   part to the left and to the right of the boundary gives the stretch with that period.
4. *All positions.* When a pair is replaced, all its occurrences are in the sequence, so the
   runs of X are copied to these positions. Stretches of one period that overlap by
   the period or more are merged. Every run lies whole in the lowest nonterminal around it,
   where its boundary crosses it, so the merged stretches are the runs; of the stretches
   with the same words that with the smallest period counts.

All of it is done inside a task on whole texts; nothing is shuffled. One text is
held whole, with about 100 bytes a word of its repeated stretches.

Edge cases. Null and empty texts have no words. Rows are independent: repeated rows and
null ids give a row each, an empty table none, and other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.arrowtext import pieces
from trialstats.llm.words import mix64

LEAST = 12
_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k ids from each position on."""
    own = mix64(ids.astype(np.uint64) + np.uint64(1))
    m = len(ids) - k + 1
    value = np.zeros(max(m, 0), np.uint64)
    for j in range(k):
        value = value * _MUL + own[j:j + m]
    return mix64(value)


def repeated_stretches(ids: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """(start, end) rows of maximal stretches covered by k-grams that the text holds twice. ``text``: ascending text numbers."""
    m = len(ids) - k + 1
    if m < 2:
        return np.zeros((0, 2), np.int64)
    value = _grams(ids, k) + mix64(text[:m].astype(np.uint64) + np.uint64(7))
    inside = text[:m] == text[k - 1:]
    at = np.flatnonzero(inside)
    at = at[np.argsort(value[at], kind="stable")]
    same = value[at[1:]] == value[at[:-1]]
    twice = np.zeros(m, bool)
    twice[at[1:][same]] = True
    twice[at[:-1][same]] = True
    depth = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + k, -1)
    covered = np.cumsum(depth[:-1]) > 0
    edge = covered.copy()
    edge[1:] &= ~covered[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(edge)
    last = covered.copy()
    last[:-1] &= ~covered[1:] | (text[1:] != text[:-1])
    return np.stack([first, np.flatnonzero(last) + 1], axis=1)


def repair(ids: np.ndarray, stretch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Re-Pair of the stretches of ``ids``; yields (rule of each occurrence, its position, left length, whole length) of each round's rules.

    ``stretch``: ascending stretch numbers. Occurrences of a rule come in ascending order of position.
    """
    _, seq = np.unique(stretch * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)
    seq = seq.astype(np.int64)
    pos, size, of = np.arange(len(ids)), np.ones(len(ids), np.int64), stretch.copy()
    symbols = int(seq.max(initial=-1)) + 1
    while len(seq) > 1:
        at = np.flatnonzero(of[1:] == of[:-1])
        pair, back, count = np.unique(seq[at] * symbols + seq[at + 1], return_inverse=True, return_counts=True)
        best = np.zeros(int(of[-1]) + 1, np.int64)
        owner = np.zeros(len(pair), np.int64)
        owner[back] = of[at]
        np.maximum.at(best, owner, count)
        going = best[of] >= 2
        wanted = (count == best[owner]) & (count >= 2)
        rank = mix64(np.arange(len(pair), dtype=np.uint64))
        # a tied pair is replaced now if no tied pair that touches it has a smaller rank
        here = np.full(len(seq) + 1, np.iinfo(np.uint64).max, np.uint64)
        which = np.full(len(seq) + 1, -1, np.int64)
        hit = wanted[back]
        here[at[hit]], which[at[hit]] = rank[back[hit]], back[hit]
        least = np.full(len(pair), np.iinfo(np.uint64).max, np.uint64)
        for step in (-1, 1):
            near = at[hit] + step
            other = which[near] != back[hit]
            np.minimum.at(least, back[hit][other], here[near][other])
        chosen = wanted & (rank < least)
        take = at[chosen[back]]
        kind = back[chosen[back]]
        # a pair of equal symbols overlaps itself: every second of its occurrences in a row
        fresh = np.ones(len(take), bool)
        fresh[1:] = (take[1:] != take[:-1] + 1) | (kind[1:] != kind[:-1])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(take)), 0))
        even = (np.arange(len(take)) - begin) % 2 == 0
        take, kind = take[even], kind[even]
        if len(take):
            left, whole = size[take], size[take] + size[take + 1]
            yield kind, pos[take], left, whole
            seq[take], size[take] = symbols + kind, whole
            keep = going
            keep[take + 1] = False
        else:
            keep = going
        if not keep.all():
            ended = ~going
            ended[take + 1] = False
            if ended.any():
                yield from _join_rest(pos[ended], size[ended], of[ended])
            seq, pos, size, of = seq[keep], pos[keep], size[keep], of[keep]
        _, seq = np.unique(seq, return_inverse=True)
        symbols = int(seq.max(initial=-1)) + 1


def _join_rest(pos: np.ndarray, size: np.ndarray, of: np.ndarray):
    """Nonterminals above the sequences that Re-Pair leaves: neighbours in twos, level by level."""
    while True:
        first = np.ones(len(of), bool)
        first[1:] = of[1:] != of[:-1]
        nth = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
        left = np.flatnonzero((nth[:-1] % 2 == 0) & (of[1:] == of[:-1]))
        if not len(left):
            return
        yield np.arange(len(left)), pos[left], size[left], size[left] + size[left + 1]
        size[left] += size[left + 1]
        keep = np.ones(len(of), bool)
        keep[left + 1] = False
        pos, size, of = pos[keep], size[keep], of[keep]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix; compared in blocks that double."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = a[at:at + step][:n - at] != b[at:at + step][:n - at]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return n


def runs_at(ids: np.ndarray, grams: np.ndarray, side: int, start: int, boundary: int, end: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches inside [start, end) with a period that cross the boundary, at least max(least, 2 * period) long.

    A stretch whose period is a multiple of that of a longer one with the same words may be left out. ``grams``: hashes
    of ``side`` words; as many at least, on one side of the boundary, equal those a period away.
    """
    found: list[tuple[int, int, int]] = []
    right, left = end - boundary, boundary - start
    cases = []
    # period <= right: compare what follows the boundary, and what precedes it, with the same a period later
    p = np.arange(1, right + 1)
    cases += _near(grams, side, boundary, p, 1, start, end)
    p = np.arange(1, left + 1)
    cases += _near(grams, side, boundary, p, -1, start, end)
    for p, way in sorted(cases):
        other = boundary + way * p
        if any(p % q == 0 and a <= min(boundary, other) and max(boundary, other) <= b for a, b, q in found):
            continue
        low, high = min(boundary, other), max(boundary, other)
        ahead = _common(ids[low:end], ids[high:end])
        behind = _common(ids[start:low][::-1], ids[start:high][::-1])
        if ahead + behind + p >= max(least, 2 * p):
            found.append((low - behind, high + ahead, p))
    return found


def _near(grams: np.ndarray, side: int, boundary: int, p: np.ndarray, way: int, start: int, end: int) -> list[tuple[int, int]]:
    """Periods p whose words next to the boundary equal those a period away, on one side at least."""
    other = boundary + way * p
    ok = np.zeros(len(p), bool)
    after = np.flatnonzero(np.maximum(other, boundary) + side <= end)
    ok[after] = grams[other[after]] == grams[boundary] if len(after) else False
    before = np.flatnonzero(np.minimum(other, boundary) - side >= start)
    if len(before):
        ok[before] |= grams[other[before] - side] == grams[boundary - side]
    return [(int(x), way) for x in p[ok]]


def find_runs(ids: np.ndarray, text: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) rows, in order, of all runs of the word ids; runs do not cross texts. ``text``: ascending text numbers."""
    empty = np.zeros((0, 3), np.int64)
    areas = repeated_stretches(ids, text, max(least // 2, 1))
    areas = areas[areas[:, 1] - areas[:, 0] >= least]
    if not len(areas):
        return empty
    sizes = areas[:, 1] - areas[:, 0]
    ends = np.cumsum(sizes)
    where = np.arange(ends[-1]) + np.repeat(areas[:, 0] - (ends - sizes), sizes)
    own, stretch = ids[where], np.repeat(np.arange(len(areas)), sizes)
    side = max(1, -(-least // 4))  # max(least - p, p) words match at least, half of them on one side
    grams = _grams(own, side)
    out: list[np.ndarray] = []
    for kind, pos, left, whole in repair(own, stretch):
        enough = whole >= least
        order = np.flatnonzero(enough)
        order = order[np.argsort(kind[order], kind="stable")]
        if not len(order):
            continue
        cut = np.flatnonzero(np.diff(kind[order])) + 1
        for same in np.split(order, cut):
            i = same[0]
            a = int(pos[i])
            found = runs_at(own, grams, side, a, a + int(left[i]), a + int(whole[i]), least)
            if found:
                rows = np.array(found)
                rows[:, :2] -= a
                shift = np.repeat(pos[same], len(rows))
                rows = np.tile(rows, (len(same), 1))
                rows[:, 0] += shift
                rows[:, 1] += shift
                out.append(rows)
    if not out:
        return empty
    rows = merged(np.concatenate(out))
    return np.stack([where[rows[:, 0]], where[rows[:, 1] - 1] + 1, rows[:, 2]], axis=1)


def merged(rows: np.ndarray) -> np.ndarray:
    """Maximal stretches of (start, end, period) rows, each with its smallest period, by start and period."""
    rows = rows[np.lexsort((-rows[:, 1], rows[:, 0], rows[:, 2]))]
    reach = np.zeros(len(rows), np.int64)
    new = np.ones(len(rows), bool)
    last = -1
    for i, (a, b, p) in enumerate(rows.tolist()):
        joins = i > 0 and rows[i - 1, 2] == p and a <= last - p
        new[i] = not joins
        last = max(last, b) if joins else b
        reach[i] = last
    first = np.flatnonzero(new)
    whole = rows[first].copy()
    whole[:, 1] = reach[np.append(first[1:], len(rows)) - 1]
    whole = whole[np.lexsort((whole[:, 2], whole[:, 1], whole[:, 0]))]
    keep = np.ones(len(whole), bool)
    keep[1:] = (whole[1:, :2] != whole[:-1, :2]).any(axis=1)
    whole = whole[keep]
    return whole[np.lexsort((whole[:, 2], whole[:, 0]))]


def word_ids(texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, text numbers) of the words of several texts; equal words have one id."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for words in texts for w in words], np.int64)
    return ids, np.repeat(np.arange(len(texts)), [len(words) for words in texts])


def planted(words: list[bytes], key: int) -> list[bytes]:
    """The words, of which a tail chosen by ``key`` is made periodic when ``key`` ends in 0 (for tests of the detection at scale)."""
    n, g = len(words), key // 10
    if key % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, plant_key: str | None = None) -> DataFrame:
    """One row per text: id, n_words, runs (array of start, length, period) and collapsed, the words without repetitions, joined by one space.

    A word is left out of ``collapsed`` if a run holds it after that run's first period.
    ``plant_key``: a SQL expression of a non-negative number with which ``planted`` changes the text first.
    """
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    key = F.expr(plant_key).cast("long") if plant_key else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).cast("string").cast("binary").alias("text"))
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()),
                        T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.BinaryType())])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, at in pieces(batch.column(2)):
                raw = data.tobytes()
                keys = batch.column(1)[row:end].to_pylist()
                texts = [raw[a:b].split() for a, b in zip(at[:-1], at[1:])]  # bytes.split() takes the six ASCII white-space bytes
                texts = [w if k is None else planted(w, k) for w, k in zip(texts, keys)]
                ids, text = word_ids(texts)
                found = find_runs(ids, text, least)
                first = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
                dropped = np.zeros(len(ids) + 1, np.int64)
                np.add.at(dropped, found[:, 0] + found[:, 2], 1)
                np.add.at(dropped, found[:, 1], -1)
                keep = np.cumsum(dropped)[:-1] == 0
                cut = np.searchsorted(found[:, 0], first)
                runs, kept = [], []
                for i, words in enumerate(texts):
                    own = found[cut[i]:cut[i + 1]]
                    runs.append([{"start": int(a - first[i]), "length": int(b - a), "period": int(p)} for a, b, p in own])
                    if len(own):
                        words = [w for w, k in zip(words, keep[first[i]:first[i + 1]].tolist()) if k]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row:end], pa.array(map(len, texts), pa.int64()),
                     pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(kept, pa.binary())], names=out.names)

    return rows.mapInArrow(detect, out)


def run_digest(found: DataFrame) -> DataFrame:
    """Per text of ``periodic_runs``: the number of runs, the longest one, and digests of the runs and of the collapsed text."""
    best = F.reduce("runs", F.element_at("runs", 1), lambda m, r: F.when(
        (r["length"] > m["length"]) | ((r["length"] == m["length"]) & ((r["start"] < m["start"]) | ((r["start"] == m["start"]) & (r["period"] < m["period"])))), r).otherwise(m))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return (found.withColumn("best", F.when(F.size("runs") > 0, best))
            .select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
