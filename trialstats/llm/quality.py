"""Quality rules: gradient-boosted trees over document statistics.

The statistics of every whole text are computed in NumPy over Arrow batches. The
trees are trained in NumPy on a bounded sample of labelled rows
(``max_training_rows``, those with the smallest hashes of their id) and scored
from flat node arrays, a whole batch at once. Chosen features are monotone: more
symbols, repeated words, repeated lines or capitals can only lower a score.

Plan. One pass without a shuffle; the sampled labels, bounded by the parameter,
are broadcast for one more pass that computes the sample's statistics.

Edge cases. A null or empty text has no words: all its counts are 0, it fails the
base rules and is not kept. Null ids are passed on and never join a label; labels
without an id or a value are left out; repeated labels each count. Without any
usable label, or with labels of one kind only, the base rules alone decide. An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.arrowtext import pieces, text_udf
from trialstats.llm.words import WordHasher, mix64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words")
#: Feature name: +1 / -1 for a score that may only rise / fall with it, 0 for free.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1, "digits": 0, "marks": -1, "distinct_words": 0, "words_per_line": 0}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def document_counts(hasher: WordHasher, data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` and ``MORE_COUNTS`` of each text ``data[at[i]:at[i+1]]``."""
    n = len(at) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[at])

    words = hasher(data, at, lower=False)
    text = words.text
    out = {"n_words": words.counts, "word_chars": per_text(~_SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_text(_SYMBOL[data]),
           "n_upper": per_text((data >= 65) & (data <= 90)), "n_digits": per_text((data >= 48) & (data <= 57)), "n_marks": per_text((data == 33) | (data == 63))}
    # lines with a word, by text and content
    begin = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], np.flatnonzero(data[:-1] == 10) + 1])) if len(data) else np.zeros(0, np.int64)
    end = np.concatenate([begin[1:], [len(data)]])[:len(begin)]
    end = end - (data[end - 1] == 10)
    some = np.concatenate([[0], np.cumsum(~_SPACE[data])])
    full = some[end] > some[begin]
    begin, end = begin[full], end[full]
    line_text = np.searchsorted(at, begin, "right") - 1
    out["n_lines"] = np.bincount(line_text, minlength=n)
    again, _ = _repeats(line_text, hasher.ranges(data, begin, end)) if len(begin) else (np.zeros(0, bool), None)
    out["n_dup_lines"] = np.bincount(line_text[again], minlength=n)
    again, _ = _repeats(text, words.hash)
    out["n_distinct_words"] = words.counts - np.bincount(text[again], minlength=n)
    # words in a 3-word window that is found twice or more
    covered = np.zeros(len(text), bool)
    if len(text) >= 3:
        inside = np.flatnonzero(text[2:] == text[:-2])
        h = words.hash
        window = mix64(h[inside] * np.uint64(3) + mix64(h[inside + 1] + np.uint64(1)) * np.uint64(5) + mix64(h[inside + 2] + np.uint64(2)) * np.uint64(7))
        _, twice = _repeats(text[inside], window)
        for k in range(3):
            covered[inside[twice] + k] = True
    out["n_repeat_words"] = np.bincount(text[covered], minlength=n)
    return out


def _repeats(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the entries equal to an earlier one of their text, and of those equal to any other one."""
    order = np.lexsort((value, text))  # stable, so the first of equals is the earliest
    same = (text[order][1:] == text[order][:-1]) & (value[order][1:] == value[order][:-1])
    later, any_ = np.zeros(len(text), bool), np.zeros(len(text), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return later, any_


def feature_matrix(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rows by ``FEATURES``, from counts; shares of no words or lines are 0."""
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    columns = {"log_words": np.log1p(c["n_words"]), "word_length": c["word_chars"] / words, "symbols": c["n_symbols"] / words,
               "dup_lines": c["n_dup_lines"] / lines, "repeat_words": c["n_repeat_words"] / words, "upper": c["n_upper"] / chars,
               "digits": c["n_digits"] / chars, "marks": c["n_marks"] / words, "distinct_words": c["n_distinct_words"] / words, "words_per_line": c["n_words"] / lines}
    return np.column_stack([columns[f] for f in FEATURES])


@dataclass
class Trees:
    """Complete trees of one depth as flat node arrays: node i has children 2i+1 and 2i+2; a leaf may sit at any depth."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # go right where the value is above; +inf stays left
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; all rows go down a tree together."""
        total = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Second-order boosting of the logistic loss on binned features.

    A split on a monotone feature whose children are in the wrong order is not taken, and the
    subtrees below a taken one are held to their side of the children's midpoint.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    margin, inner = np.full(len(y), start), (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        nodes = {0: (np.arange(len(y)), -np.inf, np.inf)}
        for node in range(2 * inner + 1):
            if node not in nodes:
                continue
            rows, low, high = nodes.pop(node)
            value = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))
            if node >= inner:
                leaf[t, node - inner] = rate * value
                margin[rows] += rate * value
                continue
            best = _best_split(code[rows], g[rows], h[rows], edges, monotone, low, high, ridge, least)
            if best is None:  # everything goes left, down to one leaf
                nodes[2 * node + 1] = (rows, low, high)
                continue
            j, cut, left, right = best
            feature[t, node], threshold[t, node] = j, edges[j][cut]
            go = code[rows, j] > cut
            middle = (left + right) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(monotone[j], ((low, high), (low, high)))
            nodes[2 * node + 1], nodes[2 * node + 2] = (rows[~go], *bounds[0]), (rows[go], *bounds[1])
    return Trees(feature, threshold, leaf, start)


def _best_split(code, g, h, edges, monotone, low, high, ridge, least):
    best, gain = None, 1e-6
    base = g.sum() ** 2 / (h.sum() + ridge)
    for j, e in enumerate(edges):
        if not len(e):
            continue
        size = len(e) + 1
        gl, hl, nl = (np.cumsum(np.bincount(code[:, j], w, size))[:-1] for w in (g, h, None))
        gr, hr, nr = g.sum() - gl, h.sum() - hl, len(g) - nl
        left, right = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
        score = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - base
        score[(nl < least) | (nr < least) | ((right - left) * monotone[j] < 0)] = -np.inf
        k = int(np.argmax(score))
        if score[k] > gain:
            best, gain = (j, k, left[k], right[k]), score[k]
    return best


def _counted(docs: DataFrame, id_col: str, text_col: str, trees: Trees | None, extra: list[str] = ()) -> DataFrame:
    """Counts of each row, after its id and the extra columns; with ``trees`` also its score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    kept = [rows.schema["doc_id"], *[rows.schema[c] for c in extra]]
    out = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE_COUNTS)], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            parts = [document_counts(hasher, data, at) for _, _, data, at in pieces(batch.column(1))]
            if not parts:
                continue
            c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            score = trees.probability(feature_matrix(c)) if trees else np.ones(len(c["n_words"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(2 + i) for i in range(len(extra))],
                                              *[pa.array(c[k].astype(np.int64)) for k in (*COUNTS, *MORE_COUNTS)], pa.array(score)], names=out.names)

    return rows.mapInArrow(run, out)


def train_on_labels(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
                    label_col: str = "quality", max_training_rows: int = 20_000) -> Trees | None:
    """Trees trained on at most ``max_training_rows`` labelled rows; None without two kinds of labels."""
    sample = (labels.select(F.col(label_id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).dropna()
              .orderBy(F.xxhash64("label_id"), "label_id", "label").limit(max_training_rows))
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    rows = _counted(some, "doc_id", "text", None, ["label"]).drop("doc_id", "score").toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)  # the same trees whatever the order of the rows
    y = rows.pop("label").to_numpy(float)
    if len(np.unique(y)) < 2:
        return None
    return train_trees(feature_matrix({c: rows[c].to_numpy() for c in rows}), y, list(FEATURES.values()))


def judge_quality(docs: DataFrame, trees: Trees | None, *, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, score and kept (base rules held and a score of at least ``least_score``)."""
    counted = _counted(docs, id_col, text_col, trees)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= least_score))


def keep_good(docs: DataFrame, trees: Trees | None, *, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that ``judge_quality`` keeps, with all their columns, in one pass."""

    def make():
        hasher = WordHasher()

        def good(texts: pa.Array) -> pa.Array:
            out = []
            for _, _, data, at in pieces(texts):
                c = document_counts(hasher, data, at)
                keep = (c["n_words"] >= 50) & (100 * c["n_repeat_words"] <= 50 * c["n_words"])
                out.append(keep & (trees.probability(feature_matrix(c)) >= least_score) if trees else keep)
            return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

        return good

    return docs.where(text_udf(make, "boolean")(F.col(text_col).cast("string")))
