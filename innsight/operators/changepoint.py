"""Is it me? Step changes of a property relative to the rest of its market."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight import config
from innsight.functions.frames import attach, half_even, month_label, scope
from innsight.functions.stats import bh_qvalues, no_nan, t_statistic, t_two_sided
from innsight.operators.units import series_keys

CHANGEPOINT_COLUMNS = [
    "property_id", "aspect", "change_month", "delta", "direction",
    "raw_delta", "market_delta", "p_value", "q_value",
]


def centred_months(monthly: DataFrame) -> DataFrame:
    """Monthly sums plus each series' own level ``alpha`` and centred sum ``c``."""
    series = Window.partitionBy(*series_keys(monthly))
    first = F.row_number().over(series.orderBy("month")) == 1
    n_all, s_all, ss_all = (F.sum(x).over(series) for x in ("n", "s", "ss"))
    return (
        monthly.withColumn("alpha", s_all / n_all)
        .withColumn("dfw", n_all - 1)
        .withColumn("ssw", F.greatest(F.lit(0.0), ss_all - s_all * s_all / n_all))
        .withColumn("opens", first)
        .withColumn("c", F.col("n") * (F.col("s") / F.col("n") - F.col("alpha")))
    )


def own_levels(monthly: DataFrame) -> DataFrame:
    """Per series: own level, and the pooled within variance of the other properties."""
    rows = centred_months(monthly).where("opens").drop("month", "n", "s", "ss", "opens", "c")
    keys = [*scope(monthly), "aspect"]
    pooled = rows.groupBy(*keys).agg(F.sum("ssw").alias("ssw_all"), F.sum("dfw").alias("dfw_all"))
    return (attach(rows, pooled, keys).withColumn("v_loo", _leave_one_out_variance())
            .drop("ssw_all", "dfw_all"))


def _leave_one_out_variance() -> Column:
    dof = F.col("dfw_all") - F.col("dfw")
    return F.coalesce(F.when(dof > 0, (F.col("ssw_all") - F.col("ssw")) / dof), F.lit(1.0))


def market_adjusted_months(monthly: DataFrame,
                           min_properties: int = config.MIN_PROPERTIES_FOR_SCOPE) -> DataFrame:
    """Monthly sums with the leave-one-out market of the same aspect and month.

    The market is the mean deviation of the other properties from their own levels. Aspects
    with fewer than ``min_properties`` properties have none; the others lose the months in
    which no other property has a review. Totals are aggregated (map-side first) and joined
    back, so no task holds all properties of a market.
    """
    months = centred_months(monthly)
    keys = [*scope(monthly), "aspect"]
    aspect = Window.partitionBy(*keys)  # one row per calendar month
    totals = (
        months.groupBy(*keys, "month").agg(
            F.sum("n").alias("n_all"), F.sum("c").alias("c_all"),
            F.sum(F.when(F.col("opens"), F.col("ssw")).otherwise(0.0)).alias("w"),
            F.sum(F.when(F.col("opens"), F.col("dfw")).otherwise(0)).alias("d"),
            F.count_if("opens").alias("o"))
        .withColumn("ssw_all", F.sum("w").over(aspect))
        .withColumn("dfw_all", F.sum("d").over(aspect))
        .withColumn("n_properties", F.sum("o").over(aspect))
        .drop("w", "d", "o")
    )
    has_market = F.col("n_properties") >= min_properties
    others = F.col("n_all") - F.col("n")
    market = F.when(F.col("residual"), (F.col("c_all") - F.col("c")) / others).otherwise(0.0)
    n, s, mk = F.col("n"), F.col("s"), F.col("market")
    return (
        attach(months, totals, [*keys, "month"])
        .withColumn("residual", has_market)
        .where(~F.col("residual") | (others > 0))
        .withColumn("market", market)
        .withColumn("mvar", F.when(F.col("residual"), _leave_one_out_variance() / others)
                    .otherwise(0.0))
        .withColumn("rs", s - n * mk)
        .withColumn("rss", F.col("ss") - 2 * mk * s + n * mk * mk)
        .select(*series_keys(monthly), "month", "n", "s", "ss", "residual", "market", "mvar",
                "rs", "rss")
    )


def split_statistics(months: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per month of each series: the shift if the month opens the 'after' side.

    Needs n, rs, rss, s, mvar. A series has at most one row per calendar month, so the
    running sums are over short, bounded partitions.
    """
    series = Window.partitionBy(*keys)
    before = series.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)

    def sides(value: Column) -> tuple[Column, Column]:
        head = F.sum(value).over(before)
        return head, F.sum(value).over(series) - head

    n1, n2 = sides(F.col("n"))
    s1, s2 = sides(F.col("rs"))
    ss1, ss2 = sides(F.col("rss"))
    raw1, raw2 = sides(F.col("s"))
    mk1, mk2 = sides(F.col("n") * F.col("n") * F.col("mvar"))
    rows = (
        months.withColumn("k", F.count(F.lit(1)).over(before))
        .withColumn("months", F.count(F.lit(1)).over(series))
        .withColumn("n1", n1).withColumn("n2", n2).withColumn("s1", s1).withColumn("s2", s2)
        .withColumn("ss1", ss1).withColumn("ss2", ss2)
        .withColumn("raw1", raw1).withColumn("raw2", raw2)
        .withColumn("mk1", mk1).withColumn("mk2", mk2)
        .where("n1 > 0 and n2 > 0")
    )
    return shift_columns(rows)


def shift_columns(rows: DataFrame) -> DataFrame:
    """delta, raw_delta, se, dof, t from the two sides' sums (n, s, ss, raw, mk)."""
    n1, n2 = F.col("n1"), F.col("n2")
    within = (F.greatest(F.lit(0.0), F.col("ss1") - F.col("s1") * F.col("s1") / n1)
              + F.greatest(F.lit(0.0), F.col("ss2") - F.col("s2") * F.col("s2") / n2))
    dof = (n1 + n2 - 2).cast("double")
    pooled = F.when(dof > 0, within / dof)
    # Sums of squares that cancel to rounding noise are a true zero spread.
    pooled = F.when(pooled > 1e-13, pooled).otherwise(F.when(dof > 0, 0.0))
    market = F.col("mk1") / (n1 * n1) + F.col("mk2") / (n2 * n2)
    return (
        rows.withColumn("delta", F.col("s2") / n2 - F.col("s1") / n1)
        .withColumn("raw_delta", F.col("raw2") / n2 - F.col("raw1") / n1)
        .withColumn("dof", dof)
        .withColumn("se", F.sqrt(pooled * (1 / n1 + 1 / n2) + market))
        .withColumn("t", t_statistic(F.col("delta"), F.col("se")))
        .drop("s1", "s2", "ss1", "ss2", "raw1", "raw2", "mk1", "mk2")
    )


def best_split(
    months: DataFrame,
    keys: Sequence[str],
    min_months: int = config.CHANGEPOINT_MIN_MONTHS,
    min_units: int = config.CHANGEPOINT_MIN_UNITS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per series the admissible split with the largest abs(t), earliest on ties."""
    candidates = split_statistics(months, keys).where(
        (F.col("k") >= min_months) & (F.col("months") - F.col("k") >= min_months)
        & (F.col("n1") >= min_units) & (F.col("n2") >= min_units)
        & (F.col("n1") + F.col("n2") >= 3))
    picked = ["month", "delta", "raw_delta", "se", "dof", "t", "n1", "n2", *carry]
    return (
        candidates.groupBy(*keys)
        .agg(F.max_by(F.struct(*picked), F.struct(F.abs("t"), -F.col("k"))).alias("_best"),
             F.count(F.lit(1)).alias("n_splits"))
        .select(*keys, "n_splits", *[F.col(f"_best.{c}").alias(c) for c in picked])
    )


def with_split_p(best: DataFrame) -> DataFrame:
    """Two-sided p of the best split, Bonferroni over the splits searched."""
    return best.withColumn("p_value", F.least(
        F.lit(1.0), F.col("n_splits") * no_nan(t_two_sided(F.col("t"), F.col("dof")))))


def tested_series(monthly: DataFrame) -> DataFrame:
    """Every series' best market-adjusted split with p and q, before any threshold."""
    adjusted = market_adjusted_months(monthly)
    best = with_split_p(best_split(adjusted, series_keys(monthly), carry=["residual"]))
    return bh_qvalues(best, "p_value", scope(monthly))


def detect_changepoints(monthly: DataFrame, min_effect: float = config.CHANGEPOINT_MIN_EFFECT,
                        q: float = config.FDR_Q) -> DataFrame:
    """Significant shifts against the market; thresholds on unrounded values."""
    kept = tested_series(monthly).where(
        (F.col("q_value") <= q) & (F.abs("delta") >= min_effect))
    market = F.when(F.col("residual"), F.col("raw_delta") - F.col("delta"))
    return kept.select(
        *scope(monthly), "property_id", "aspect",
        month_label(F.col("month")).alias("change_month"),
        half_even(F.col("delta"), 3).alias("delta"),
        F.when(F.col("delta") < 0, "negative").otherwise("positive").alias("direction"),
        half_even(F.col("raw_delta"), 3).alias("raw_delta"),
        half_even(market, 3).alias("market_delta"),
        "p_value", "q_value",
    )


def shift_at(months: DataFrame, keys: Sequence[str], after: Column) -> DataFrame:
    """Shift per series at a split chosen in advance: ``after`` marks the later side.

    Rows with an empty side or fewer than three units carry no shift and are dropped.
    """
    return shift_columns(side_sums(months, keys, after)
                         .where("n1 >= 1 and n2 >= 1 and n1 + n2 >= 3"))


def side_sums(months: DataFrame, keys: Sequence[str], after: Column) -> DataFrame:
    """Sums of both sides of one given split: conditional sums, one aggregation."""
    measures = {"n": F.col("n"), "s": F.col("rs"), "ss": F.col("rss"), "raw": F.col("s"),
                "mk": F.col("n") * F.col("n") * F.col("mvar")}
    aggs = [F.sum(F.when(after if later else ~after, value).otherwise(0))
            .alias(f"{name}{2 if later else 1}")
            for name, value in measures.items() for later in (False, True)]
    return (
        months.groupBy(*keys)
        .agg(*aggs, F.count_if(~after).alias("months1"), F.count_if(after).alias("months2"))
        .withColumn("mean1", F.when(F.col("n1") > 0, F.col("raw1") / F.col("n1")))
        .withColumn("mean2", F.when(F.col("n2") > 0, F.col("raw2") / F.col("n2")))
    )
