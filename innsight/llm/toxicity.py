"""Toxicity by subword-bag embeddings and a linear softmax (operator 2).

A word is the bag of its character n-grams, so a misspelling shares most vectors with the word it
comes from. N-gram vectors and the softmax are trained jointly in numpy: a span of text is
the average of its words, a word the average of its n-grams. A long text with one toxic
sentence would average out, so the unit that is classified is a window of ``WINDOW``
words, and a text scores as its worst window; training picks that window anew in each epoch.

As the model is linear, a word's share of the softmax's log-odds is one number, which tasks keep
by word; scoring a text is then a running sum.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.common import documents, slices, text_or_empty
from innsight.llm.labelled import held_out, training_sample

BUCKETS, DIMENSIONS = 1 << 15, 16
SHORTEST, LONGEST = 3, 6
WINDOW = 3
#: A word of more characters is cut in pieces, which take the place of words; neighbouring ones share LONGEST - 1 characters.
LONG, PIECE = 64, 16
#: Stands where a piece was cut from its word; no word has it.
CUT = "\0"
WARM_EPOCHS, EPOCHS, RATE, DECAY = 15, 90, 0.05, 0.02
#: Words a task remembers; a full memory is emptied.
CACHE_WORDS = 300_000

_WORDS = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    """Words of the text in order, long ones in pieces."""
    words = _WORDS(text.lower())
    if words and len(max(words, key=len)) > LONG:
        return [p for w in words for p in (pieces(w) if len(w) > LONG else (w,))]
    return words


def pieces(word: str) -> list[str]:
    """Overlapping pieces with CUT at the cut ends: each n-gram of the word lies whole in one of them."""
    step = PIECE - (LONGEST - 1)
    starts = range(0, len(word) - (LONGEST - 1), step)
    return [CUT * (at > 0) + word[at:at + PIECE] + CUT * (at + PIECE < len(word)) for at in starts]


def ngrams(word: str) -> list[int]:
    """Buckets of the word, or piece of one, in marks and of its n-grams; a cut end has no mark."""
    marked = f"<{word}>".replace("<" + CUT, "").replace(CUT + ">", "")
    grams = {marked[i:i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)}
    grams.add(marked)
    return [zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams)]


@dataclass(frozen=True)
class Model:
    """Vectors by bucket (BUCKETS x DIMENSIONS), softmax weights (DIMENSIONS x 2) and biases."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def log_odds(self) -> tuple[np.ndarray, float]:
        """Each bucket's share of the log-odds of class 1, and the constant."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0])


def worst_window(odds: np.ndarray) -> tuple[int, int]:
    """Start and length of the window whose mean is largest; the first of equals."""
    if len(odds) <= WINDOW:
        return 0, len(odds)
    sums = np.cumsum(np.concatenate([[0.0], odds]))
    return int(np.argmax(sums[WINDOW:] - sums[:-WINDOW])), WINDOW


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit vectors and softmax on (text, 0/1) rows; without both classes only the bias is informed."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)
    counts = Counter(w for text in texts for w in words_of(text))
    known = {w: i for i, w in enumerate(w for w, n in counts.items() if n > 1)}  # the rest would be learned by heart
    rows, kept = [], []
    for text, label in zip(texts, labels, strict=True):
        if ids := [known[w] for w in words_of(text) if w in known]:
            rows.append(np.array(ids, np.int32))
            kept.append(label)
    if len(set(kept)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return Model(vectors * 0, weights, np.log([1 - share, share]))
    target = np.eye(2)[kept]
    grams = [ngrams(w) for w in known]
    sizes = np.array([len(g) for g in grams])
    flat = np.fromiter(chain.from_iterable(grams), np.int32, sizes.sum())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, weights, bias)]
    for epoch in range(1, WARM_EPOCHS + EPOCHS + 1):
        share = vectors @ weights  # of each bucket in each class's logit
        word = np.add.reduceat(share[flat], starts) / sizes[:, None]
        if epoch <= WARM_EPOCHS:
            units = rows
        else:
            odds = word[:, 1] - word[:, 0]
            units = [r[s:s + n] for r in rows for s, n in [worst_window(odds[r])]]
        lengths = np.array([len(u) for u in units])
        at, of = np.concatenate(units), np.repeat(np.arange(len(units)), lengths)
        logits = np.add.reduceat(word[at], np.concatenate([[0], np.cumsum(lengths)[:-1]])) / lengths[:, None] + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - target) / len(units)
        by_word = _summed(at, (error / lengths[:, None])[of], len(sizes)) / sizes[:, None]
        by_bucket = _summed(flat, by_word[owner], BUCKETS)
        gradients = (by_bucket @ weights.T, vectors.T @ by_bucket, error.sum(0))
        for parameter, (m, v), g in zip((vectors, weights, bias), state, gradients, strict=True):
            # Adam with one scale for a whole array: a rare n-gram must not move as far as a frequent one
            m += 0.1 * (g - m)
            v += 0.01 * ((g * g).mean() - v)
            parameter *= 1 - RATE * DECAY
            parameter -= RATE * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.99 ** epoch)) + 1e-8)
    return Model(vectors, weights, bias)


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], 1)


class Scorer(dict):
    """Log-odds by word; a word that isn't known yet is made of its n-grams."""

    def __init__(self, shares: np.ndarray, constant: float):
        self.shares, self.constant = shares, constant

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = float(self.shares[ngrams(word)].mean())
        return out

    def score(self, text: str) -> float:
        words = words_of(text)
        odds = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        start, n = worst_window(odds)
        log_odds = self.constant + (odds[start:start + n].mean() if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(log_odds, -30, 30))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score in (0, 1) for every row of ``docs``, whole texts.

    Defined cases: a null text is empty, and a text without words scores by the constant alone; a word of more
    than LONG characters, such as text without spaces, counts as its pieces; of windows
    equally bad the first counts, which changes no score; repeated rows and null ids are rows like
    others; an empty table gives no rows; other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.log_odds())  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            scores = [scorer.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    return own.mapInArrow(run, "doc_id bigint, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows that aren't held out."""
    docs = documents(spark, sf_dir)
    model = train(*training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
