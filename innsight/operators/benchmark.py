"""Lead / lag of every property-aspect against its cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight import config
from innsight.functions.frames import attach, scope, taxonomy_rank
from innsight.functions.stats import bh_qvalues, z_two_sided
from innsight.operators.units import series_keys

BENCHMARK_COLUMNS = [
    "property_id", "aspect", "mean", "n", "n_reviews", "ci_low", "ci_high",
    "cluster_mean", "diff", "p_value", "q_value", "flag",
]
SCORECARD_COLUMNS = [
    "aspect", "mean", "ci_low", "ci_high", "n", "cluster_mean", "diff", "flag",
    "n_reviews", "q_value",
]


def profiles(cells: DataFrame, *extra: str, with_cells: bool = True) -> DataFrame:
    """Per series: review count, mention mean and its cluster-robust standard error.

    The sum of squared residuals (total - mean * mentions)^2 expands into sums of integers,
    so no join back to the reviews is needed. ``cells`` keeps the distinct
    (total, mentions, count) triples for the bootstrap; their number is bounded by the
    clause counts a review can have, not by the number of reviews.
    """
    keys = [*series_keys(cells), *extra]
    slim = cells.groupBy(*keys, "total", "mentions").agg(F.sum("r").alias("r"))
    t, m, r = F.col("total"), F.col("mentions"), F.col("r")
    aggs = [F.sum(r).alias("n_reviews"), F.sum(r * m).alias("n"), F.sum(r * t).alias("sum_t"),
            F.sum(r * t * t).alias("tt"), F.sum(r * t * m).alias("tm"),
            F.sum(r * m * m).alias("mm")]
    if with_cells:
        aggs.append(F.collect_list(F.struct("total", "mentions", "r")).alias("cells"))
    mean = F.col("mean")
    dev2 = F.col("tt") - 2 * mean * F.col("tm") + mean * mean * F.col("mm")
    exact = F.when(dev2 > 1e-12 * (F.col("tt") + F.col("mm")), dev2).otherwise(0.0)
    count = F.col("n_reviews")
    return (
        slim.groupBy(*keys).agg(*aggs)
        .withColumn("mean", F.col("sum_t") / F.col("n"))
        .withColumn("se", F.when(count >= 2, F.sqrt(count / (count - 1) * exact) / F.col("n")))
        .drop("sum_t", "tt", "tm", "mm")
    )


def against_cluster(profile: DataFrame, *extra: str) -> DataFrame:
    """Add the unweighted cluster mean of each aspect and the difference from it."""
    keys = [*scope(profile), "aspect", *extra]
    means = profile.groupBy(*keys).agg(F.avg("mean").alias("cluster_mean"))
    joined = profile.join(means, keys) if extra else attach(profile, means, keys)
    return joined.withColumn("diff", F.col("mean") - F.col("cluster_mean"))


def with_p_values(compared: DataFrame,
                  min_reviews: int = config.MIN_REVIEWS_FOR_FLAG) -> DataFrame:
    """Two-sided z test of the difference, for series with enough reviews."""
    z = F.abs(F.col("diff")) / F.col("se")
    p = (F.when(F.col("se") > 0, z_two_sided(F.when(F.col("se") > 0, z)))
         .when(F.col("se") == 0, F.when(F.col("diff") != 0, 0.0).otherwise(1.0)))
    return compared.withColumn("p_value", F.when(F.col("n_reviews") >= min_reviews, p))


def bootstrap_ci(n_boot: int = config.BOOTSTRAP_SAMPLES, level: float = config.CI_LEVEL):
    """Percentile interval of the mention mean, resampling whole reviews.

    Drawing r reviews with replacement is one multinomial draw over the cells, so the cost
    depends on the number of distinct cells and not on the number of reviews.
    """
    tails = [(1 - level) / 2, 1 - (1 - level) / 2]

    @F.pandas_udf(T.StructType([T.StructField("ci_low", T.DoubleType()),
                                T.StructField("ci_high", T.DoubleType())]))
    def interval(cells: pd.Series, seed: pd.Series) -> pd.DataFrame:
        rows = []
        for triples, start in zip(cells, seed, strict=True):
            if triples is None or len(triples) == 0:
                rows.append((None, None))
                continue
            grid = np.array(sorted((int(c["total"]), int(c["mentions"]), int(c["r"]))
                                   for c in triples), dtype=np.int64)
            count = int(grid[:, 2].sum())
            if count < 2:
                rows.append((None, None))
                continue
            draws = np.random.default_rng(int(start)).multinomial(
                count, grid[:, 2] / count, size=n_boot)
            means = (draws @ grid[:, 0]) / (draws @ grid[:, 1])
            rows.append(tuple(np.quantile(means, tails, method="linear")))
        return pd.DataFrame(rows, columns=["ci_low", "ci_high"])

    return interval


def group_seed():
    return F.crc32(F.concat_ws("|", "property_id", "aspect"))


def with_ci(df: DataFrame, min_reviews: int = config.MIN_REVIEWS_FOR_FLAG,
            n_boot: int = config.BOOTSTRAP_SAMPLES) -> DataFrame:
    shown = F.when(F.col("n_reviews") >= min_reviews, F.col("cells"))
    return (
        df.withColumn("_ci", bootstrap_ci(n_boot)(shown, group_seed()))
        .withColumn("ci_low", F.col("_ci.ci_low")).withColumn("ci_high", F.col("_ci.ci_high"))
        .drop("_ci", "cells")
    )


def with_flags(df: DataFrame, margin: float = config.BENCHMARK_MARGIN,
               q: float = config.FDR_Q) -> DataFrame:
    significant = F.col("q_value") <= q
    lead = significant & (F.col("diff") > margin) & (F.col("ci_low") > F.col("cluster_mean"))
    lag = significant & (F.col("diff") < -margin) & (F.col("ci_high") < F.col("cluster_mean"))
    return df.withColumn("flag", F.when(lead, "lead").when(lag, "lag").otherwise("on_par"))


def tested_profiles(cells: DataFrame, with_cells: bool = True) -> DataFrame:
    """Profiles with p and q values over every eligible series of the cluster."""
    tested = with_p_values(against_cluster(profiles(cells, with_cells=with_cells)))
    return bh_qvalues(tested, "p_value", scope(cells))


def benchmark_vs_cluster(cells: DataFrame, property_id: str | None = None,
                         n_boot: int = config.BOOTSTRAP_SAMPLES) -> DataFrame:
    """Flag each property-aspect as lead / lag / on_par.

    ``property_id`` restricts the rows after the q-values and before the bootstrap: a
    property's answer never depends on which property was asked about.
    """
    tested = tested_profiles(cells)
    if property_id is not None:
        tested = tested.where(F.col("property_id") == property_id)
    return with_flags(with_ci(tested, n_boot=n_boot)).select(*scope(cells), *BENCHMARK_COLUMNS)


def scorecard(cells: DataFrame, property_id: str, aspects: list[str]) -> DataFrame:
    rows = benchmark_vs_cluster(cells, property_id)
    return rows.orderBy(taxonomy_rank(F.col("aspect"), aspects)).select(*SCORECARD_COLUMNS)


def leads_and_lags(bench: DataFrame) -> DataFrame:
    """Per property, the aspects it leads and lags on (at most the taxonomy's size)."""
    def listed(flag: str):
        return F.array_sort(F.collect_list(F.when(F.col("flag") == flag, F.col("aspect"))))
    return bench.groupBy(*scope(bench), "property_id").agg(
        listed("lead").alias("leads"), listed("lag").alias("lags"))
