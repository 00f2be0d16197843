"""A quality classifier: histogram gradient-boosted trees over document statistics, in flat arrays.

Each document becomes a row of statistics of its whole text. A tree is a complete binary tree of a fixed depth whose
nodes lie in arrays (statistic, threshold); all rows of a batch walk one level at a time with one indexed comparison.

Learning reads a bounded sample: labelled rows are drawn by hashed id at a rate that gives about ``sample_rows`` of them,
and only drawn rows are joined. Defined cases: a null text is empty and scored like any other; rows without a label,
or with a null one, teach nothing; with no labelled rows the score is 0.5, with labels of one kind only that kind's
share, smoothed; labels repeated for a document count as often as they stand; repeated rows stay; other columns are
kept, those with the names of results replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import written

STATISTICS = (
    "log_bytes", "log_words", "word_length", "longest_word", "unique_words", "top_word", "lower", "upper", "digits", "spaces", "sentence_marks", "other_marks",
    "symbols", "exclamations", "bars", "non_ascii", "lines", "line_length", "repeated_lines", "ended_lines",
)


def _class(characters: bytes) -> np.ndarray:
    return np.frombuffer(characters, np.uint8)


LOWER, UPPER, DIGIT, SPACE = _class(bytes(range(97, 123))), _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b" \t\n\x0b\x0c\r")
SENTENCE, OTHER, SYMBOL = _class(b".,;:?"), _class(b"\"'()[]{}/\\-_=+"), _class(b"#*$%&|<>^~@")


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(len(data), 1)
    share = lambda cls: float(seen[cls].sum()) / size
    words = data.split()
    counts = Counter(words)
    n = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    rows = max(len(lines), 1)
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), sum(map(len, words)) / n, float(max(map(len, words), default=0)), len(counts) / n, max(counts.values(), default=0) / n,
        share(LOWER), share(UPPER), share(DIGIT), share(SPACE), share(SENTENCE), share(OTHER),
        share(SYMBOL), float(seen[33]) / size, float(seen[124]) / size, float(seen[128:].sum()) / size, float(np.log1p(len(lines))), len(data) / rows, 1 - len(set(lines)) / rows,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / rows,
    ]


def with_statistics(docs: DataFrame, text_col: str = "text", keep_text: bool = False, column: str = "statistics") -> DataFrame:
    docs = docs.drop(column) if column in docs.columns else docs
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.list_(pa.float32()))], names=[*(f.name for f in kept), column])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(column, T.ArrayType(T.FloatType()))]))


@dataclass
class Forest:
    """Flat trees: of node k the children are 2k + 1 and 2k + 2; a node without a split sends every row to the left."""

    start: float
    feature: np.ndarray  # trees, inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees, leaves

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        every, inner = np.arange(len(rows)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(rows), np.int64)
            while inner and node[:1].size and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.15, shrink: float = 1.0, least: float = 2.0) -> Forest:
    """Boosted trees for the log-odds of label 1."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    start = float(np.log(share / (1 - share)))
    forest = Forest(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(labels) or labels.min() == labels.max():
        return forest
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T)], axis=1)  # bin b: above edge b - 1, up to edge b
    total, parts = np.full(len(rows), start), []
    offsets = np.arange(rows.shape[1]) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = labels - p, p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            cell = ((node - first)[:, None] * rows.shape[1] * bins + offsets + binned).ravel()
            shape = (width, rows.shape[1], bins)
            g = np.bincount(cell, np.repeat(slope, rows.shape[1]), width * rows.shape[1] * bins).reshape(shape)
            h = np.bincount(cell, np.repeat(bend, rows.shape[1]), width * rows.shape[1] * bins).reshape(shape)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + shrink) + (ga - gl) ** 2 / (ha - hl + shrink) - ga**2 / (ha + shrink)
            gain[(hl < least) | (ha - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > threshold[node])
        g, h = np.bincount(node - inner, slope, leaves), np.bincount(node - inner, bend, leaves)
        leaf = rate * g / (h + shrink)
        total += leaf[node - inner]
        parts.append((feature, threshold, leaf))
    return Forest(start, *(np.stack(x) for x in zip(*parts)))


def learn(described: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = 20_000) -> Forest:
    """Trees from the labelled rows of ``described`` (with statistics) for which ``teaches`` holds (a condition on the id)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(teaches).select(id_col, F.col(label_col).cast("int").alias("label"))
    count = known.count()
    if count > sample_rows:
        drawn = F.xxhash64(F.col(id_col), F.lit("draw")).cast("double") / 2.0**64 + 0.5 <= sample_rows / count
        known, described = known.where(drawn), described.where(drawn)
    rows = known.join(described.select(id_col, "statistics").where(teaches), id_col).select(id_col, "label", "statistics").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    return fit(np.array([r.statistics for r in rows], np.float64).reshape(len(rows), len(STATISTICS)), np.array([r.label for r in rows], np.float64))


def score(described: DataFrame, forest: Forest, column: str = "score") -> DataFrame:
    """``described`` with the score in place of the statistics."""
    described = described.drop(column) if column in described.columns else described
    kept = [f for f in described.schema.fields if f.name != "statistics"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(batch.schema.get_field_index("statistics"))
            rows = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), len(STATISTICS))
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(forest.score(rows))], names=[*(f.name for f in kept), column])

    return described.mapInArrow(run, T.StructType([*kept, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the text, with the score."""
    described = written(with_statistics(docs, text_col), "quality-statistics")
    return score(described, learn(described, labels, teaches, id_col, **options))
