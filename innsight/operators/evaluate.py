"""Scoring labels against human annotations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.functions.frames import scope
from innsight.functions.stats import wilson

CLASSES = (-1, 0, 1)
NO_ASPECT = "none"


# --- E1-E2: predictions and labelling slices ---------------------------------------------


def predictions(reviews: DataFrame, mentions: DataFrame, aspects: list[str]) -> DataFrame:
    """Per review ``A;B`` and ``A=s;B=s`` in taxonomy order; blank when nothing is found."""
    rank = F.array_position(F.lit(aspects), F.col("aspect"))
    units = mentions.groupBy("review_id", "aspect").agg(
        F.signum(F.sum("sentiment").cast("double")).cast("int").alias("s"))
    listed = units.groupBy("review_id").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "aspect", "s"))).alias("u"))
    names = F.transform("u", lambda x: x["aspect"])
    pairs = F.transform("u", lambda x: F.concat(x["aspect"], F.lit("="), x["s"].cast("string")))
    return reviews.select("review_id").join(listed, "review_id", "left").select(
        "review_id",
        F.coalesce(F.array_join(names, ";"), F.lit("")).alias("pred_aspects"),
        F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias("pred_sentiment_per_aspect"))


def hash_slice(review_id: Column, slices: int) -> Column:
    """int(sha256(id)) mod slices, folded over the hex digits."""
    digits = F.split(F.sha2(review_id.cast("string"), 256), "")
    return F.aggregate(
        F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"),
        lambda acc, d: F.pmod(acc * 16 + F.conv(d, 16, 10).cast("long"), F.lit(slices)))


def labelling_slices(frame: DataFrame, annotators: list[str]) -> DataFrame:
    if not annotators:
        raise ValueError("at least one annotator is required")
    position = hash_slice(F.col("review_id"), len(annotators))
    return frame.withColumn("annotator", F.element_at(
        F.lit(annotators), (position + 1).cast("int")))


# --- E3: label cells -----------------------------------------------------------------------


def _parts(cell: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(cell.cast("string"), F.lit("")), ";"),
                          lambda p: F.trim(p))
    return F.filter(trimmed, lambda p: p != "")


def parse_labels(frame: DataFrame, prefix: str, taxonomy: list[str]) -> DataFrame:
    """Cells -> review_id, aspects, sentiments, labelled, problem (null when valid).

    Aspects and sentiments come out in taxonomy order; a repeated aspect keeps its last
    sentiment; an aspect with a sentiment counts as named.
    """
    have = set(frame.columns)
    empty = F.lit(None).cast("string")
    names_cell = F.col(f"{prefix}_aspects") if f"{prefix}_aspects" in have else empty
    pairs_name = f"{prefix}_sentiment_per_aspect"
    pairs_cell = F.col(pairs_name) if pairs_name in have else empty
    lowered = [t.lower() for t in taxonomy]
    rows = frame.select(
        F.regexp_replace(F.trim(F.coalesce(F.col("review_id").cast("string"), F.lit(""))),
                         r"^(\d+)\.0+$", "$1").alias("review_id"),
        F.coalesce(F.col("notes") if "notes" in have else empty, F.lit("")).alias("notes"),
        F.coalesce(F.col("text") if "text" in have else empty, F.lit("")).alias("text"),
        F.transform(_parts(names_cell), lambda p: F.lower(p)).alias("names"),
        F.transform(_parts(pairs_cell), lambda p: F.struct(
            F.lower(F.trim(F.substring_index(p, "=", 1))).alias("name"),
            F.when(F.contains(p, F.lit("=")),
                   F.trim(F.regexp_replace(p, "^[^=]*=", ""))
                   ).alias("raw"))).alias("pairs"),
    )
    known = F.lit(lowered)
    good = F.col("pairs")
    bad_name = F.exists("names", lambda n: ~F.array_contains(known, n) & (n != NO_ASPECT))
    bad_pair_name = F.exists(good, lambda p: ~F.array_contains(known, p["name"]))
    number = "^[+-]?0*[01]$"
    bad_value = F.exists(good, lambda p: ~F.coalesce(p["raw"].rlike(number), F.lit(False)))
    problem = (F.when(F.col("review_id") == "", "empty review_id")
               .when(bad_value, "invalid sentiment label")
               .when(bad_name | bad_pair_name, "unknown aspect"))

    def last_value(name: str) -> Column:
        hits = F.filter("pairs", lambda p: p["name"] == name.lower())
        return F.try_element_at(hits, F.lit(-1))["raw"].try_cast("int")

    sentiments = F.filter(
        F.array(*[F.struct(F.lit(t).alias("aspect"), last_value(t).alias("s"))
                  for t in taxonomy]),
        lambda x: x["s"].isNotNull())

    def is_named(name: str) -> Column:
        return F.array_contains("names", name.lower()) | F.exists(
            "pairs", lambda p: p["name"] == name.lower())

    named = F.array_compact(F.array(*[F.when(is_named(t), F.lit(t)) for t in taxonomy]))
    return rows.select(
        "review_id", "notes", "text", named.alias("aspects"), sentiments.alias("sentiments"),
        ((F.size("names") > 0) | (F.size("pairs") > 0)).alias("labelled"),
        problem.alias("problem"))


def check_labels(parsed: DataFrame) -> None:
    """Raise on the first kind of bad label, with one aggregate job."""
    bad = parsed.where(F.col("problem").isNotNull()).select("problem", "review_id").first()
    if bad is not None:
        raise ValueError(f"{bad['problem']} (review_id {bad['review_id']!r})")
    twice = parsed.groupBy("review_id").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"duplicate review_id {twice['review_id']!r}")


# --- E4-E7: metrics ------------------------------------------------------------------------


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def with_prf(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 from tp, fp, fn; 0/0 is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (counts.withColumn("precision", _ratio(tp, tp + fp))
            .withColumn("recall", _ratio(tp, tp + fn))
            .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn)))


def aspect_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(review, aspect) rows of labelled reviews with gold and predicted marks."""
    truth = gold.where("labelled").select("review_id", F.explode("aspects").alias("aspect"),
                                          F.lit(1).alias("g"), F.lit(0).alias("p"))
    found = (pred.join(gold.where("labelled").select("review_id"), "review_id", "left_semi")
             .select("review_id", F.explode("aspects").alias("aspect"),
                     F.lit(0).alias("g"), F.lit(1).alias("p")))
    return truth.unionByName(found).groupBy("review_id", "aspect").agg(
        F.max("g").alias("g"), F.max("p").alias("p"))


def aspect_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One-vs-rest precision, recall, F1 per aspect."""
    g, p = F.col("g"), F.col("p")
    return with_prf(aspect_pairs(gold, pred).groupBy("aspect").agg(
        F.sum(g * p).alias("tp"), F.sum((1 - g) * p).alias("fp"),
        F.sum(g * (1 - p)).alias("fn")))


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def matched_sentiments(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Sentiment pairs on aspects that both sides carry."""
    def flat(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("review_id", F.explode("sentiments").alias("_s")).select(
            "review_id", "_s.aspect", F.col("_s.s").alias(name))
    return flat(gold.where("labelled"), "gold").join(flat(pred, "pred"), ["review_id", "aspect"])


def confusion(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """3 x 3 counts: one row per gold class, one column per predicted class."""
    cells = pairs.groupBy(*keys, "gold").agg(*[
        F.count_if(F.col("pred") == c).alias(f"pred_{'neg' if c < 0 else 'pos' if c else 'neu'}")
        for c in CLASSES])
    return cells


def class_scores(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per-class precision, recall, F1 (classes that occur on either side)."""
    sides = F.explode(F.array(
        F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"),
                 (F.col("gold") == F.col("pred")).cast("int").alias("hit")),
        F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"),
                 (F.col("gold") == F.col("pred")).cast("int").alias("hit"))))
    rows = pairs.select(*keys, sides.alias("_x")).select(*keys, "_x.*")
    g, hit = F.col("g"), F.col("hit")
    return with_prf(rows.groupBy(*keys, "label").agg(
        F.sum(g * hit).alias("tp"), F.sum((1 - g) * (1 - hit)).alias("fp"),
        F.sum(g * (1 - hit)).alias("fn")))


def sentiment_summary(pairs: DataFrame) -> DataFrame:
    """Matched pairs, accuracy and macro F1 in one row."""
    base = pairs.agg(F.count(F.lit(1)).alias("n_matched"),
                     F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"))
    return base.crossJoin(class_scores(pairs).agg(F.avg("f1").alias("macro_f1")))  # 1 x 1 row


def error_analysis(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Reviews and aspect errors per difficulty category."""
    notes = F.lower("notes")
    words = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != ""))
    category = (
        F.when(notes.rlike("sarcas|ironi"), "sarcasm")
        .when((F.size("aspects") > 1) | notes.rlike("mixed"), "mixed_aspects")
        .when(((words > 0) & (words <= 3)) | notes.rlike("very short|short review"),
              "very_short"))
    found = pred.select("review_id", F.col("aspects").alias("found"))
    rows = gold.where("labelled").withColumn("category", category).where(
        F.col("category").isNotNull()).join(found, "review_id", "left")
    wrong = F.array_sort("aspects") != F.array_sort(
        F.coalesce("found", F.array().cast("array<string>")))
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if(wrong).alias("errors"))


def coverage_counters(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Labelled, skipped, missing and surplus reviews in one row."""
    marks = gold.select("review_id", F.when(F.col("labelled"), 1).otherwise(0).alias("lab"),
                        F.when(F.col("labelled"), 0).otherwise(1).alias("skip"),
                        F.lit(0).alias("pred")).unionByName(
        pred.select("review_id", F.lit(0).alias("lab"), F.lit(0).alias("skip"),
                    F.lit(1).alias("pred")))
    per_review = marks.groupBy("review_id").agg(
        F.max("lab").alias("lab"), F.max("skip").alias("skip"), F.max("pred").alias("pred"))
    return per_review.agg(
        F.sum("lab").alias("n_reviews"), F.sum("skip").alias("n_unlabelled_skipped"),
        F.count_if((F.col("lab") == 1) & (F.col("pred") == 0)).alias("n_missing_predictions"),
        F.count_if((F.col("lab") == 0) & (F.col("pred") == 1)).alias("n_predictions_without_gold"))


def macro_f1_interval(cells: DataFrame, keys: list[str], n_boot: int = 500,
                      seed: int = 42) -> DataFrame:
    """Percentile interval of macro F1, resampling the 3 x 3 confusion counts.

    ``cells`` has keys, gold, pred, n. A row resample of any test set is one multinomial
    draw over nine counts, so the test set itself never reaches Python.
    """
    packed = cells.groupBy(*keys).agg(
        F.collect_list(F.struct("gold", "pred", "n")).alias("cells"))
    out = T.StructType([T.StructField(c, T.DoubleType()) for c in ("f1_low", "f1_high")])

    @F.pandas_udf(out)
    def interval(column: pd.Series) -> pd.DataFrame:
        rows = []
        for entries in column:
            grid = np.zeros((3, 3))
            for e in entries:
                grid[int(e["gold"]) + 1, int(e["pred"]) + 1] += e["n"]
            total = int(grid.sum())
            draws = np.random.default_rng(seed).multinomial(
                total, grid.ravel() / total, size=n_boot).reshape(-1, 3, 3)
            hits = draws[:, [0, 1, 2], [0, 1, 2]]
            sides = draws.sum(axis=1) + draws.sum(axis=2)
            f1 = np.divide(2.0 * hits, sides, out=np.zeros(hits.shape), where=sides > 0)
            rows.append(tuple(np.percentile(f1.mean(axis=1), [2.5, 97.5])))
        return pd.DataFrame(rows, columns=["f1_low", "f1_high"])

    return packed.withColumn("_ci", interval("cells")).select(*keys, "_ci.*")


# --- E8-E9: detection rates -------------------------------------------------------------------


def rate_table(outcomes: DataFrame, measures: list[str]) -> DataFrame:
    """k, n, rate and Wilson interval of boolean columns, one row per measure."""
    sums = outcomes.agg(F.count(F.lit(1)).alias("n"),
                        *[F.count_if(F.coalesce(F.col(m), F.lit(False))).alias(m)
                          for m in measures])
    packed = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("k"))
                                 for m in measures]))
    rows = sums.select("n", packed.alias("_m")).select("_m.measure", "_m.k", "n")
    low, high = wilson(F.col("k"), F.col("n"))
    return rows.withColumn("rate", F.when(F.col("n") > 0, F.col("k") / F.col("n"))).withColumn(
        "ci_low", low).withColumn("ci_high", high)


def detection_outcomes(clusters: DataFrame, truth: DataFrame, changepoints: DataFrame) -> DataFrame:
    """Per cluster: was the true decline found (within a month, exactly), and extras.

    ``truth`` has keys (cluster_id, property_id, aspect, true_month); detections are the
    changepoint rows of many clusters.
    """
    keys = [*scope(clusters), "property_id", "aspect"]
    found = changepoints.select(*keys, "change_month", "direction")
    gap = F.months_between(F.to_date(F.concat(F.col("change_month"), F.lit("-01"))),
                           F.to_date(F.concat(F.col("true_month"), F.lit("-01"))))
    judged = found.join(truth, keys, "left").withColumn("is_true", F.col("true_month").isNotNull())
    hit = F.col("is_true") & (F.col("direction") == "negative")
    per = judged.groupBy(*scope(clusters)).agg(
        F.bool_or(hit & (F.abs(gap) <= 1)).alias("found"),
        F.bool_or(hit & (gap == 0)).alias("exact_month"),
        F.count_if(~F.col("is_true")).alias("extra"))
    return clusters.join(per, scope(clusters), "left").select(
        *scope(clusters), F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("exact_month", F.lit(False)).alias("exact_month"),
        F.coalesce("extra", F.lit(0).cast("long")).alias("extra"),
        (F.coalesce("extra", F.lit(0)) > 0).alias("any_extra"))
