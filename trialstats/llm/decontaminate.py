"""Benchmark decontamination: short test items inside long documents, by containment.

An item is found in a document that holds at least ``percent`` per cent of the
item's distinct 5-word shingles.

Items are partitioned by size. An item of n shingles in a partition is known by a
MinHash sketch of its own size: the n - ceil(n * percent / 100) + 1 shingles with
the smallest hashes. A document that holds enough of the item cannot miss all of
them (it may miss one less), so testing a document's shingles against the sketches
finds every pair, however long the document is, and a document with fewer
shingles than the partition's smallest items need is skipped for it. Every
candidate pair is verified by exact counting of the item's shingles.

Plan. Items are a query set: they are taken in blocks of at most about
``block_shingles`` shingles, each block broadcast (its size is known before) for
one pass over the documents without a shuffle. Documents are read whole.

Edge cases. Null or empty texts have no shingles and match nothing. A text of one
to four words is one shingle, so such an item is found only where it is a whole
text. Repeated items (same id and shingles) count once, repeated documents each.
Null ids are returned as they are. Empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.arrowtext import pieces, text_udf
from trialstats.llm.shared import written
from trialstats.llm.words import WordHasher, distinct_by_text, shingle_hashes

_TABLE_BITS = 20


def shingle_sets(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, shingles): each row's distinct shingle hashes as ascending little-endian 64-bit words."""
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets: list[np.ndarray] = []
            for _, _, data, at in pieces(batch.column(1)):
                values, bounds = distinct_by_text(*shingle_hashes(hasher(data, at)))
                sets += [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=[f.name for f in out])

    return rows.mapInArrow(run, out)


class ItemIndex:
    """Sketches of a block of items, by size partition, for membership tests of many shingles."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.percent = sets, percent
        sizes = np.array([len(s) for s in sets], np.int64)
        self.need = -(-sizes * percent // 100)
        keys, items = [], []
        for i, s in enumerate(sets):
            sketch = s[:len(s) - self.need[i] + 1]  # ascending, so the smallest hashes
            keys.append(sketch)
            items.append(np.full(len(sketch), i))
        keys, items = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[keys >> np.uint64(64 - _TABLE_BITS)] = True
        partition = np.frexp(sizes.astype(float))[1]  # sizes in [2^(p-1), 2^p)
        self.partition = partition
        self.least = {int(p): int(self.need[partition == p].min()) for p in np.unique(partition)}

    def search(self, values: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of all pairs that reach the share. values, at: distinct ascending shingles by text."""
        hit = np.flatnonzero(self.table[values >> np.uint64(64 - _TABLE_BITS)])
        low = np.searchsorted(self.keys, values[hit], "left")
        high = np.searchsorted(self.keys, values[hit], "right")
        hit, low, high = hit[high > low], low[high > low], high[high > low]
        if not len(hit):
            return
        counts = high - low
        item = self.items[np.arange(counts.sum()) + np.repeat(low - (np.cumsum(counts) - counts), counts)]
        text = np.repeat(np.searchsorted(at, hit, "right") - 1, counts)
        sizes = np.diff(at)
        for pair in np.unique(text * len(self.sets) + item).tolist():
            d, i = divmod(pair, len(self.sets))
            if sizes[d] < self.least[int(self.partition[i])]:
                continue
            own, its = values[at[d]:at[d + 1]], self.sets[i]
            where = np.minimum(np.searchsorted(own, its), len(own) - 1)
            shared = int((own[where] == its).sum())
            if shared >= self.need[i]:
                yield d, i, shared


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", percent: int = 75, block_shingles: int = 1 << 20) -> DataFrame:
    """One row per (document, item) found: doc_id, item_id, shared and item_shingles."""
    sets, blocks = _item_blocks(items, item_id_col, item_text_col, block_shingles)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", sets.schema["id"].dataType),
                           T.StructField("shared", T.LongType()), T.StructField("item_shingles", T.LongType())])
    return reduce(DataFrame.unionAll, [_search_block(rows, block, percent, schema) for block in blocks])


def without_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                  percent: int = 75, block_shingles: int = 1 << 20) -> DataFrame:
    """Rows of ``docs`` in which no item is found, with all their columns."""
    _, blocks = _item_blocks(items, item_id_col, item_text_col, block_shingles)
    for block in blocks:
        if block:
            docs = docs.where(_is_clean([bytes(r["shingles"]) for r in block], docs, percent)(F.col(text_col).cast("string")))
    return docs


def _is_clean(block: list[bytes], docs: DataFrame, percent: int):
    shared_sets = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        index, hasher = ItemIndex([np.frombuffer(s, np.uint64) for s in shared_sets.value], percent), WordHasher()

        def clean(texts: pa.Array) -> pa.Array:
            out = np.ones(len(texts), bool)
            for row, _, data, offsets in pieces(texts):
                for d, _, _ in index.search(*distinct_by_text(*shingle_hashes(hasher(data, offsets)))):
                    out[row + d] = False
            return pa.array(out)

        return clean

    return text_udf(make, "boolean")


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_shingles: int) -> tuple[DataFrame, Iterator[list]]:
    """The items' sets, and their rows in blocks of about ``block_shingles`` shingles."""
    sets = written(shingle_sets(items, id_col, text_col).where("n > 0").dropDuplicates(["id", "shingles"]), "items")
    total = sets.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // block_shingles))
    of = F.pmod(F.xxhash64("id", "shingles"), F.lit(n))
    return sets, (sets.where(of == b).orderBy("id", "shingles").collect() for b in range(n))


def _search_block(rows: DataFrame, block: list, percent: int, schema: T.StructType) -> DataFrame:
    if not block:
        return rows.sparkSession.createDataFrame([], schema)
    ids = [r["id"] for r in block]
    shared_sets = rows.sparkSession.sparkContext.broadcast([bytes(r["shingles"]) for r in block])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex([np.frombuffer(s, np.uint64) for s in shared_sets.value], percent)
        hasher = WordHasher()
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for row, _, data, at in pieces(batch.column(1)):
                values, bounds = distinct_by_text(*shingle_hashes(hasher(data, at)))
                found += [(row + d, i, n) for d, i, n in index.search(values, bounds)]
            if found:
                d, i, n = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(d)), pa.array([ids[k] for k in i]), pa.array(n, pa.int64()), pa.array([len(index.sets[k]) for k in i], pa.int64())],
                    names=schema.names)

    return rows.mapInArrow(run, schema)
