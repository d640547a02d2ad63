"""Test statistics: tails and quantiles on small aggregated rows, FDR control at any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.functions.frames import stage

# --- tails and quantiles (one Arrow batch of aggregated rows at a time) ------------------

# Exp-sinh quadrature nodes for integrals over (0, inf).
_U = np.arange(-4.2, 4.2001, 0.05)
_NODES = np.exp(0.5 * np.pi * np.sinh(_U))
_WEIGHTS = 0.05 * 0.5 * np.pi * np.cosh(_U) * _NODES


def _upper_tail(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(T > t): the density at |t| times the integral of its ratio to that value."""
    a, v = np.abs(t)[:, None], dof[:, None]
    power = -(v + 1.0) / 2.0
    scale = np.where(a > 1.0, (v + a * a) / ((v + 1.0) * np.maximum(a, 1.0)), 1.0)
    x = a + scale * _NODES
    ratio = np.exp(power * (np.log1p(x * x / v) - np.log1p(a * a / v)))
    log_const = np.array([[math.lgamma((d + 1.0) / 2.0) - math.lgamma(d / 2.0)] for d in dof])
    density = np.exp(log_const - 0.5 * np.log(np.pi * v) + power * np.log1p(a * a / v))
    tail = (ratio * _WEIGHTS).sum(axis=1) * (scale * density)[:, 0]
    return np.where(t == 0, 0.5, np.where(t > 0, tail, 1.0 - tail))


def student_tail(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Upper tail of Student's t; NaN without degrees of freedom, 0 or 1 at infinity."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    out = np.full(t.shape, np.nan)
    usable = ~np.isnan(t) & (dof > 0)
    out[usable & np.isinf(t)] = 0.0
    out[usable & np.isinf(t) & (t < 0)] = 1.0
    rows = np.flatnonzero(usable & np.isfinite(t))
    for part in np.array_split(rows, max(1, len(rows) // 4096)):
        if len(part):
            out[part] = _upper_tail(t[part], dof[part])
    return out


def student_quantile(prob: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """t with P(T <= t) = prob, by bisection over the distinct (prob, dof) pairs."""
    pairs = np.column_stack([np.asarray(prob, float), np.asarray(dof, float)])
    ok = (pairs[:, 0] > 0) & (pairs[:, 0] < 1) & (pairs[:, 1] > 0)
    out = np.full(len(pairs), np.nan)
    if ok.any():
        distinct, where = np.unique(pairs[ok], axis=0, return_inverse=True)
        low, high = np.full(len(distinct), -1e3), np.full(len(distinct), 1e3)
        for _ in range(64):
            mid = 0.5 * (low + high)
            below = 1.0 - student_tail(mid, distinct[:, 1]) < distinct[:, 0]
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        out[ok] = (0.5 * (low + high))[where.reshape(-1)]
    return out


@F.pandas_udf(T.DoubleType())
def t_upper(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(student_tail(t.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(2.0 * student_tail(t.abs().to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def t_quantile(prob: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(student_quantile(prob.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def z_two_sided(z: pd.Series) -> pd.Series:
    root = math.sqrt(2.0)
    return z.map(lambda v: math.erfc(abs(v) / root), na_action="ignore")


def t_statistic(effect: Column, se: Column) -> Column:
    """effect / se; a zero error makes any effect infinitely significant."""
    infinite = F.signum(effect) * F.lit(float("inf"))
    return F.when(se > 0, effect / se).when(effect != 0, infinite).otherwise(0.0)


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def with_t_tests(
    df: DataFrame, effect: str = "effect", se: str = "se", dof: str = "dof", level: float = 0.95
) -> DataFrame:
    """Add p_two_sided, p_upper, ci_low, ci_high for rows of (effect, se, dof)."""
    t = t_statistic(F.col(effect), F.col(se))
    df = df.withColumn("p_upper", no_nan(t_upper(t, F.col(dof).cast("double"))))
    df = df.withColumn("p_two_sided", no_nan(t_two_sided(t, F.col(dof).cast("double"))))
    df = df.withColumn("_crit", t_quantile(F.lit(0.5 + level / 2), F.col(dof).cast("double")))
    return (
        df.withColumn("ci_low", no_nan(F.col(effect) - F.col("_crit") * F.col(se)))
        .withColumn("ci_high", no_nan(F.col(effect) + F.col("_crit") * F.col(se)))
        .drop("_crit")
    )


def one_sample_upper_t(mean: Column, sd: Column, k: Column) -> tuple[Column, Column]:
    """(t, dof) for H1: mean > 0; no spread gives +inf or -inf, i.e. p = 0 or 1."""
    spread = F.coalesce(sd, F.lit(0.0))
    t = (F.when(spread > 0, mean / (spread / F.sqrt(k)))
         .otherwise(F.when(mean > 0, float("inf")).otherwise(float("-inf"))))
    return t, F.greatest(k - 1, F.lit(1)).cast("double")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k/n; null when n = 0."""
    share = F.when(n > 0, k / n)
    norm = 1 + z * z / n
    centre = (share + z * z / (2 * n)) / norm
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / norm
    return (F.when(n > 0, F.greatest(F.lit(0.0), centre - half)),
            F.when(n > 0, F.least(F.lit(1.0), centre + half)))


# --- ranks and FDR within a family of any size -------------------------------------------


def _unit_bucket(value: Column) -> Column:
    """Monotone bucket of a value in [0, 1]: 4096 linear steps, 16 per octave below them.

    At most ~22 000 buckets exist, so tables with one row per bucket stay small.
    """
    tiny = 1.0 / 4096
    return (F.when(value <= 0, F.lit(-100_000))
            .when(value < tiny, -F.floor(-F.log2(value) * 16))
            .otherwise(F.floor(F.least(value, F.lit(1.0)) * 4096)).cast("int"))


def counts_up_to(df: DataFrame, value: str, family: Sequence[str],
                 unit: Column | None = None) -> DataFrame:
    """Per distinct (family, value): ``rank`` = rows of the family with a value <= it, and
    ``size`` = rows of the family. Values lie in [0, 1], or ``unit`` maps them there in order.

    Equal values collapse first (map-side), then buckets carry the prefix counts, so no
    task ever holds or sorts a whole family.
    """
    family = list(family)
    distinct = (df.groupBy(*family, value).agg(F.count(F.lit(1)).alias("ties"))
                .withColumn("bucket", _unit_bucket(F.col(value) if unit is None else unit)))
    in_family = Window.partitionBy(*family)
    buckets = (
        distinct.groupBy(*family, "bucket").agg(F.sum("ties").alias("held"))
        .withColumn("size", F.sum("held").over(in_family))
        .withColumn("before", F.sum("held").over(
            in_family.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("held"))
        .drop("held")
    )
    in_bucket = (Window.partitionBy(*family, "bucket").orderBy(value)
                 .rowsBetween(Window.unboundedPreceding, 0))
    return (distinct.join(buckets, [*family, "bucket"])
            .withColumn("rank", F.col("before") + F.sum("ties").over(in_bucket))
            .drop("before"))


def bh_qvalues(
    df: DataFrame,
    p: str = "p_value",
    family: Sequence[str] = (),
    out: str = "q_value",
    bounded: bool = False,
) -> DataFrame:
    """Benjamini-Hochberg q-values within ``family``; rows with a null p are not counted.

    Ranks and the reverse running minimum are bucketed (see ``counts_up_to``), so a family
    has no size limit; the tested rows are staged, as they are read twice. ``bounded`` states
    that the families are no larger than the taxonomy (aspects x calendar months), for which one
    sorted window each is enough. Both are exact.
    """
    return _windowed_q(df, p, family, out) if bounded else _bucketed_q(stage(df, "tests"), p, family, out)


def _windowed_q(df: DataFrame, p: str, family: Sequence[str], out: str) -> DataFrame:
    tested = F.col(p).isNotNull()
    fam = Window.partitionBy(*family, tested)
    # Descending with a growing frame: linear, where "current row to end" is quadratic.
    later = fam.orderBy(F.col("_rk").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_rk", F.row_number().over(fam.orderBy(p)))
        .withColumn("_adj", F.col(p) * F.count(F.lit(1)).over(fam) / F.col("_rk"))
        .withColumn(out, F.when(tested, F.least(F.lit(1.0), F.min("_adj").over(later))))
        .drop("_rk", "_adj")
    )


def _bucketed_q(df: DataFrame, p: str, family: Sequence[str], out: str) -> DataFrame:
    keys = list(family) or ["_family"]
    base = df if family else df.withColumn("_family", F.lit(1))
    ranked = counts_up_to(base.where(F.col(p).isNotNull()).select(*keys, p), p, keys)
    ranked = ranked.withColumn("_adj", F.col(p) * F.col("size") / F.col("rank"))
    bucket_min = ranked.groupBy(*keys, "bucket").agg(F.min("_adj").alias("_low")).withColumn(
        "_later", F.min("_low").over(Window.partitionBy(*keys).orderBy(F.col("bucket").desc())
                                     .rowsBetween(Window.unboundedPreceding, -1)))
    onwards = (Window.partitionBy(*keys, "bucket").orderBy(F.col(p).desc())
               .rowsBetween(Window.unboundedPreceding, 0))
    table = (
        ranked.join(bucket_min.drop("_low"), [*keys, "bucket"])
        .select(*keys, F.col(p).alias("_p"),
                F.least(F.lit(1.0), F.min("_adj").over(onwards), F.col("_later")).alias(out))
    )
    # p = 1 always has q = 1 and can be a large share of a family (Bonferroni caps it):
    # those rows get spread, never-matching lookup keys instead of meeting in one task.
    probe = F.when(F.col(p) < 1, F.col(p)).otherwise(
        -1.0 - F.pmod(F.xxhash64(*base.columns), F.lit(4096)))
    return (
        base.withColumn("_p", probe).join(table, [*keys, "_p"], "left")
        .withColumn(out, F.when(F.col(p).isNotNull(), F.coalesce(F.col(out), F.lit(1.0))))
        .drop("_p", "_family")
    )
