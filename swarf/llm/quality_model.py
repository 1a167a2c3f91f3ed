"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents: binned features, gradient histograms by bincount, level
by level. A fitted forest is a few flat arrays; scoring walks all trees of a batch at once by numpy indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarf.llm.common import document
from swarf.shipping import ship

#: Most labelled documents that a fit reads; they are taken in the order of a hash of doc_id.
SAMPLE = 20_000
FEATURES = ("log_words", "word_len", "lower", "upper", "digit", "stop", "symbol", "bang", "bar", "high", "other", "short", "distinct", "top_word", "dup_lines", "line_words", "longest", "spaced", "caps_words", "punct_words")

_CLASS = np.full(256, 8, np.int64)  # of a byte: lower, upper, digit, stop, symbol, bang, bar, high, other, space
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"#*$%&<>", b"!", b"|", bytes(range(128, 256)))):
    _CLASS[list(_bytes)] = _k
_CLASS[list(b" \t\n\v\f\r")] = 9
_END = frozenset(b"#*$%&<>|!")


def statistics(text: str | None) -> list[float]:
    """FEATURES of a text; an empty one has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    share = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=10) / len(raw)
    lens = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    caps = sum(w.isupper() and len(w) > 1 for w in words)
    return [
        np.log1p(n), lens.mean(), *share[:9], (lens <= 3).mean(), len(seen) / n, max(seen.values()) / n,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), np.log1p(lens.max()), share[9], caps / n, sum(w[-1] in _END for w in words) / n,
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: split feature and threshold of each inner node, value of each leaf, by tree."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows x."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.zeros((len(x), trees), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, at - inner].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least: float = 4.0, ridge: float = 2.0) -> Forest:
    """Logistic boosting. No rows give 0.5 for all; rows of one label give a constant near it."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    base, inner = float(np.log(p / (1 - p))), 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        trees = 0
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if trees else []
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1) if trees else x
    width, total = x.shape[1], np.full(len(y), base)
    cell = binned + np.arange(width) * bins if trees else None
    for t in range(trees):
        q = 1 / (1 + np.exp(-total))
        grad, hess = y - q, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (width * bins) + cell).ravel()
            g, h = (np.bincount(key, np.repeat(v, width), count * width * bins).reshape(count, width, bins).cumsum(2) for v in (grad, hess))
            gl, hl, gt, ht = g[:, :, :-1], h[:, :, :-1], g[:, :1, -1:], h[:, :1, -1:]
            gain = np.where((hl >= least) & (ht - hl >= least), gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge), 0)
            for k in range(count):
                f, b = divmod(int(gain[k].argmax()), bins - 1)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        up, down = (np.bincount(node - inner, v, inner + 1) for v in (grad, hess))
        leaf[t] = rate * up / (down + ridge)
        total += leaf[t, node - inner]
    return Forest(base, feature, threshold, leaf)


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the crc32 of its id as text; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES."""

    ship(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column("text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, x.T)], ["doc_id", *FEATURES])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fit on at most `sample` labelled documents outside the held-out fifth; only their statistics reach the driver.

    Of texts that share an id one counts, the first by its statistics, and of labels that do the greater one; null ids and
    labels don't count. Without any row left all scores are one half.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")  # at most `sample` ids
    rows = with_statistics(mine).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "x.*").join(F.broadcast(known), "doc_id").orderBy("doc_id").toPandas()
    return fit(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float))


def classify(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, row (the whole input row).

    Only the text is an input of a score; null, empty and blank texts share one, and very long ones are read whole. Repeated
    rows score alike, and a score of just the threshold is predicted 1. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"), document(docs).alias("row"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), rows.schema["row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = forest.score(np.array([statistics(t.as_py()) for t in b.column("text")], float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), b.column("row")], [f.name for f in schema])

    return rows.mapInArrow(run, schema)
