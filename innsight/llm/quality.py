"""Quality by histogram gradient-boosted trees over document statistics (operator 5).

Statistics are cut into quantile bins once; each tree of a fixed depth is grown level by level from
gradient histograms. Trees are flattened into arrays, node i's children at 2i + 1 and 2i + 2,
so a batch of documents goes down all trees in numpy, a level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.common import documents, slices, text_or_empty
from innsight.llm.labelled import held_out, training_sample

BINS, DEPTH, TREES = 48, 4, 80
RATE, PENALTY, LEAST_HESSIAN = 0.15, 1.0, 2.0

#: Kinds of byte: 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 punctuation of prose, 6 symbol, 7 beyond ASCII.
_KIND = np.zeros(256, np.int64)
for _kind, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t\n\v\f\r"), (5, b".,;:!?'\"()-"), (6, b"#$%&*+/<=>@[\\]^_`{|}~")):
    _KIND[list(_chars)] = _kind
_KIND[128:] = 7


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; all are 0 for an empty one."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return [0.0] * 18
    bytes_of = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, bytes_of, 8) / len(raw)
    words, lines = text.split(), text.split("\n")
    n, distinct = max(1, len(words)), len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return [
        np.log1p(len(words)), distinct / n, distinct / n ** 0.8, lengths.mean(), lengths.std(), lengths.max(), (lengths == 1).mean(),
        np.log1p(len(lines)), len(set(lines)) / len(lines), len(words) / len(lines), *kinds[1:], bytes_of.max() / len(raw),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees in arrays: feature and threshold by (tree, inner node), value by (tree, leaf)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """All rows of ``x`` down all trees; a tie with a threshold goes left."""
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.value[trees, node - (2 ** DEPTH - 1)].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boost ``trees`` trees on the logistic loss. Without rows or with one class there is only a base score."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    if not 0 < y.sum() < len(y):
        return Forest(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, leaves)), base)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], 1)
    width, n_features = BINS, x.shape[1]
    flat = binned + np.arange(n_features) * width
    features, thresholds, values = [], [], []
    odds = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, hessian = p - y, p * (1 - p)
        feature, threshold, bin_at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, count = 2 ** level - 1, 2 ** level
            cell = ((node - first) * n_features * width)[:, None] + flat
            shape = (count, n_features, width)
            g = np.bincount(cell.ravel(), np.repeat(gradient, n_features), count * n_features * width).reshape(shape).cumsum(2)
            h = np.bincount(cell.ravel(), np.repeat(hessian, n_features), count * n_features * width).reshape(shape).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + PENALTY) + (g_all - g) ** 2 / (h_all - h + PENALTY) - g_all ** 2 / (h_all + PENALTY)
            gain[(h < LEAST_HESSIAN) | (h_all - h < LEAST_HESSIAN)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k], bin_at[first + k] = f, cuts[f][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > bin_at[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + PENALTY)
        odds += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Forest(np.stack(features), np.stack(thresholds), np.stack(values), base)


def train(texts: list[str], labels: list[int]) -> Forest:
    x = np.array([statistics(t) for t in texts]).reshape(len(texts), 18)
    return grow(x, np.array(labels, float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score in (0, 1) for every row of ``docs``, from statistics of whole texts.

    Defined cases: a null text is empty, and an empty text has all statistics 0 and scores as such;
    repeated rows and null ids are rows like others; an empty table gives no rows; other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)  # TREES x 2^DEPTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            x = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, 18)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.scores(x))], ["doc_id", "score"])

    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    return own.mapInArrow(run, "doc_id bigint, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the rows that aren't held out."""
    docs = documents(spark, sf_dir)
    forest = train(*training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality"))
    return score(docs, forest).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
