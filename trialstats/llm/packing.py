"""Packing of tokenised examples into training sequences: vector bin packing.

Each sequence has three limits at once: tokens, segments and loss-bearing tokens.
A sequence is filled by the dot-product rule: of the waiting examples that fit
under all limits, the one whose demand has the largest dot product with what the
sequence has left (both as shares of the limits) is placed next. What then stays
free is filled with the head of an example that is cut there. Examples above a
whole sequence are cut into whole sequences first.

Plan. One pass of Arrow batches without any shuffle: a task packs the examples of
its own input split, with a bounded number of them waiting, so memory does not
grow with the input and a lost task is simply run again. The last tokens of a task
go into sequences whose lengths are powers of two, which need no padding.

Edge cases. A null or empty text is one token, the end id. Null ids and repeated
rows are examples of their own. An empty table gives no rows; extra columns are
ignored. A very long text is cut into as many sequences as it needs. A null loss
count means that all tokens bear loss; counts are held to 0 .. tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.arrowtext import pieces
from trialstats.llm.tokenized import WordTokenizer, default_tokenizer_path


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class Packer:
    """Fills sequences from a pool of waiting examples. ``placed`` gets (example, start, length, loss, sequence, offset)."""

    def __init__(self, limits: Limits, waiting: int = 1024, least_cut: int = 4) -> None:
        self.limits, self.waiting, self.least_cut = limits, waiting, least_cut
        self.sequence = 0
        self.placed: list[tuple] = []
        self._items: list[list] = []  # example, start, end, first loss-bearing position
        self._tokens = np.zeros(2 * waiting)
        self._loss = np.zeros(2 * waiting)

    def add(self, example, n: int, loss: int) -> None:
        """One example of ``n`` tokens, the last ``loss`` of which bear loss."""
        item, cap = [example, 0, n, n - loss], self.limits
        while item[2] - item[1] >= cap.tokens or self._bearing(item, item[2]) > cap.loss:
            head = min(cap.tokens, item[2] - item[1], max(0, item[3] - item[1]) + cap.loss)
            self._emit([(item, head)])
        if item[2] > item[1]:
            self._push(item)
            if len(self._items) >= self.waiting:
                self._fill(cap.tokens, self.least_cut)

    def finish(self) -> None:
        """Pack everything that waits; the last tokens go into sequences of power-of-two lengths."""
        while self._items:
            left = int(self._tokens[:len(self._items)].sum())
            if left >= self.limits.tokens:
                self._fill(self.limits.tokens, self.least_cut)
            else:
                self._fill(1 << (left.bit_length() - 1), 1)

    @staticmethod
    def _bearing(item: list, end: int) -> int:
        return max(0, end - max(item[1], item[3]))

    def _push(self, item: list) -> None:
        i = len(self._items)
        self._items.append(item)
        self._tokens[i], self._loss[i] = item[2] - item[1], self._bearing(item, item[2])

    def _pop(self, i: int) -> list:
        item, last = self._items[i], len(self._items) - 1
        self._items[i] = self._items[last]
        self._tokens[i], self._loss[i] = self._tokens[last], self._loss[last]
        self._items.pop()
        return item

    def _fill(self, tokens: int, least_cut: int) -> None:
        cap, chosen = self.limits, []
        room, seats, loss = tokens, cap.segments, cap.loss
        while room and seats and self._items:
            n = len(self._items)
            t, q = self._tokens[:n], self._loss[:n]
            score = t * (room / cap.tokens ** 2) + q * (loss / cap.loss ** 2) + seats / cap.segments ** 2
            score[(t > room) | (q > loss)] = -1
            i = int(np.argmax(score))
            if score[i] < 0:
                break
            item = self._pop(i)
            size, bearing = item[2] - item[1], self._bearing(item, item[2])
            chosen.append((item, size))
            room, seats, loss = room - size, seats - 1, loss - bearing
        if room >= least_cut and seats and self._items:
            i = int(np.argmax(self._tokens[:len(self._items)]))
            item = self._items[i]
            head = min(room, item[2] - item[1], max(0, item[3] - item[1]) + loss)
            if head > 0 and (head >= least_cut or not chosen):
                item = self._pop(i)
                chosen.append((item, head))
        rest = [item for item, size in chosen if item[1] + size < item[2]]
        self._emit(chosen)
        for item in rest:
            self._push(item)

    def _emit(self, chosen: list[tuple[list, int]]) -> None:
        offset = 0
        for item, size in chosen:
            end = item[1] + size
            self.placed.append((item[0], item[1], size, self._bearing(item, end), self.sequence, offset))
            item[1] = end
            offset += size
        self.sequence += 1


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None,
         limits: Limits = Limits(), tokenizer_path: str | None = None, end_id: int = 2, with_ids: bool = True,
         waiting: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (, input_ids).

    ``loss_col``: number of tokens at an example's end (end id included) that bear loss; all by default.
    """
    path = tokenizer_path or default_tokenizer_path()
    loss = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), loss.alias("loss"))
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")
    out = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in names],
                        *([T.StructField("input_ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = WordTokenizer(path), Packer(limits, waiting)
        first = TaskContext.get().partitionId() << 40
        id_type = None

        def flush() -> pa.RecordBatch:
            done, packer.placed = packer.placed, []
            cut = [ids[start:start + size] for (_, ids), start, size, *_ in done]
            columns = [pa.array([d for (d, _), *_ in done], id_type), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()),
                       pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()), pa.array([len(ids) for (_, ids), *_ in done], pa.int64()),
                       pa.array([first + x[4] for x in done], pa.int64()), pa.array([x[5] for x in done], pa.int64()), pa.array([x[3] for x in done], pa.int64())]
            if with_ids:
                ends = np.cumsum([0, *map(len, cut)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*cut, np.zeros(0, np.uint32)]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids_of, bearing = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, end, data, at in pieces(batch.column(1)):
                flat, bounds = tokenizer(data, at)
                for i in range(row, end):
                    ids = np.append(flat[bounds[i - row]:bounds[i - row + 1]], end_id).astype("<u4")
                    n = len(ids)
                    packer.add((ids_of[i], ids), n, n if bearing[i] is None else min(n, max(0, bearing[i])))
                if len(packer.placed) >= 2048:
                    yield flush()
        packer.finish()
        if packer.placed:
            yield flush()

    return rows.mapInArrow(run, out)
