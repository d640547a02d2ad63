"""Reviews -> mentions: one row per (clause, aspect)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight import config
from innsight.functions import text as tx
from innsight.functions.frames import scope, stage, unnest

BatchScorer = Callable[[list[str]], Sequence[int]]


def lexicon_scorer(lexicon: dict[str, list[str]] | None) -> tx.ClauseScorer:
    return lambda clause, tokens: tx.rule_sentiment(clause, tokens, lexicon)


def mention_arrays(
    reviews: DataFrame,
    aspects: dict[str, list[str]] | None = None,
    lexicon: dict[str, list[str]] | None = None,
    sentiment: tx.ClauseScorer | None = None,
) -> DataFrame:
    """Review keys with the array of their mentions: a projection, no shuffle."""
    keep = [*scope(reviews), "review_id", "property_id", "date"]
    found = tx.text_mentions(F.col("text"), aspects, sentiment or lexicon_scorer(lexicon))
    return reviews.select(*keep, found.alias("mentions"))


def label_reviews(reviews: DataFrame, aspects: dict[str, list[str]] | None = None,
                  lexicon: dict[str, list[str]] | None = None,
                  sentiment: tx.ClauseScorer | None = None) -> DataFrame:
    """One row per mention; reviews without text or aspect give no rows.

    ``sentiment`` replaces the lexicon rule by any Column function of (clause, tokens).
    """
    keep = [*scope(reviews), "review_id", "property_id", "date"]
    return unnest(mention_arrays(reviews, aspects, lexicon, sentiment), keep, F.col("mentions"))


def aspect_clauses(reviews: DataFrame,
                   aspects: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per clause that carries an aspect, with its aspects, not yet scored."""
    keep = [*scope(reviews), "review_id", "property_id", "date"]
    clauses = tx.aspect_clauses(tx.normalise(F.col("text")), aspects or config.ASPECTS)
    return unnest(reviews, keep, clauses).select(*keep, "clause", "aspects")


def score_clauses(clauses: DataFrame, scorer: BatchScorer, batch_size: int = 1024) -> DataFrame:
    """Score every distinct clause once with a batch model: (clause, sentiment)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["clause"].tolist()
            scores: list[int] = []
            for start in range(0, len(texts), batch_size):
                scores.extend(int(s) for s in scorer(texts[start:start + batch_size]))
            if len(scores) != len(texts):
                raise ValueError("the scorer must return one score per clause")
            if set(scores) - {-1, 0, 1}:
                raise ValueError("clause scores must be -1, 0 or 1")
            yield pd.DataFrame({"clause": texts, "sentiment": scores})

    schema = T.StructType([T.StructField("clause", T.StringType()),
                           T.StructField("sentiment", T.IntegerType())])
    return clauses.select("clause").distinct().mapInPandas(score, schema)


def label_with_model(reviews: DataFrame, scorer: BatchScorer,
                     aspects: dict[str, list[str]] | None = None) -> DataFrame:
    """Cue-word aspects with model sentiment; only the sentiment differs from the rules.

    The clause table is staged: it is read once to find the distinct clauses and once to
    take the scores back. A very common clause is one scored row, and the join that returns
    it is left to the runtime, which splits skewed partitions.
    """
    clauses = stage(aspect_clauses(reviews, aspects), "clauses")
    scored = stage(score_clauses(clauses, scorer), "clause-scores")
    keep = [*scope(reviews), "review_id", "property_id", "date"]
    return clauses.join(scored, "clause", "left").select(
        *keep, F.explode("aspects").alias("aspect"), "sentiment",
        F.col("clause").alias("sentence"))


def classify_text(spark, text: str | None,
                  aspects: dict[str, list[str]] | None = None) -> DataFrame:
    """Mentions of one typed text; blank input gives an empty frame."""
    if text is not None and not isinstance(text, str):
        raise ValueError(f"text must be a string, got {type(text).__name__}")
    one = spark.range(1).select(F.lit(text).cast("string").alias("text"))
    return unnest(one, [], tx.text_mentions(F.col("text"), aspects))
