"""Mentions -> review units -> compressed cells -> monthly sums.

``unit_cells`` is the one wide shuffle of the analytics: every detector works on the small
tables derived from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.functions.frames import month_of, natural_key, scope, unnest
from innsight.functions.text import bind

SERIES = ["property_id", "aspect"]


def series_keys(df: DataFrame) -> list[str]:
    return [*scope(df), *SERIES]


def _keyed(mentions: DataFrame) -> DataFrame:
    return mentions.where(F.col("property_id").isNotNull() & F.col("aspect").isNotNull())


def _by_review(mentions: DataFrame) -> DataFrame:
    """Mentions dealt by unit. A unit has few of them, so counting before the shuffle would save
    little and hold every unit of a scan task, which may be a whole table, in its memory.
    """
    return mentions.repartition(*scope(mentions), "review_id", *SERIES)


def review_units(mentions: DataFrame) -> DataFrame:
    """One row per (review, aspect): total and count of its clauses, and their mean.

    Without ``review_id`` the unit is (property, date, aspect).
    """
    keyed = _keyed(mentions)
    totals = [F.sum("sentiment").cast("long").alias("total"),
              F.count(F.lit(1)).alias("mentions")]
    if "review_id" in mentions.columns:
        units = (_by_review(keyed.where(F.col("review_id").isNotNull()))
                 .groupBy(*scope(mentions), "review_id", *SERIES)
                 .agg(F.min("date").alias("date"), *totals))
    else:
        units = keyed.groupBy(*scope(mentions), "property_id", "date", "aspect").agg(*totals)
    return units.withColumn("value", F.col("total") / F.col("mentions"))


def units_from_array(labelled: DataFrame, mentions: str = "mentions") -> DataFrame:
    """Units straight from one row per review with its mention array: no shuffle at all."""
    def per_aspect(found: Column) -> Column:
        def unit(name: Column) -> Column:
            own = F.filter(found, lambda m: m["aspect"] == name)
            total = F.aggregate(own, F.lit(0).cast("long"),
                                lambda acc, m: acc + m["sentiment"].cast("long"))
            return F.struct(name.alias("aspect"), total.alias("total"),
                            F.size(own).cast("long").alias("mentions"))
        return F.transform(F.array_distinct(F.transform(found, lambda m: m["aspect"])), unit)

    keep = [*scope(labelled), "review_id", "property_id", "date"]
    return (
        unnest(labelled.withColumnRenamed(mentions, "_mentions"), keep,
               bind(F.col("_mentions"), per_aspect))
        .withColumn("value", F.col("total") / F.col("mentions"))
    )


def unit_cells(units: DataFrame) -> DataFrame:
    """Units with the same property, aspect, month, total and mention count, counted.

    Lossless for every statistic used here, and its size does not grow with review volume.
    """
    return (
        units.where(F.col("date").isNotNull())
        .groupBy(*series_keys(units), month_of(F.col("date")).alias("month"), "total", "mentions")
        .agg(F.count(F.lit(1)).alias("r"))
    )


def monthly_sums(cells: DataFrame) -> DataFrame:
    """n, s, ss (count, sum, sum of squares of unit values) per series and month."""
    value = F.col("total") / F.col("mentions")
    return cells.groupBy(*series_keys(cells), "month").agg(
        F.sum("r").alias("n"),
        F.sum(F.col("r") * value).alias("s"),
        F.sum(F.col("r") * value * value).alias("ss"),
    )


def mention_months(mentions: DataFrame) -> DataFrame:
    """Mention-level sums per series and month: n, total sentiment, negative count."""
    return (
        mentions.where(F.col("property_id").isNotNull() & F.col("aspect").isNotNull())
        .groupBy(*series_keys(mentions), month_of(F.col("date")).alias("month"))
        .agg(F.count("sentiment").alias("n"),
             F.sum("sentiment").cast("long").alias("total"),
             F.count_if(F.col("sentiment") < 0).alias("negative"))
    )


def unit_tallies(mentions: DataFrame) -> DataFrame:
    """Units counted by all that cells and mention-level sums need, in one pass over the mentions.

    ``named`` units have a review; the others are only mentions of one month. ``mixed`` units
    have mentions of several months (or some undated), so they don't tell each month's sums.
    """
    keys = [*scope(mentions), "review_id", *SERIES]
    dated = _keyed(mentions).withColumn("_month", month_of(F.col("date")))
    units = (
        _by_review(dated.withColumn("_own", F.when(F.col("review_id").isNull(), F.col("_month"))))
        .groupBy(*keys, "_own")
        .agg(F.min("_month").alias("month"), F.max("_month").alias("_last"),
             F.count("_month").alias("_dated"), F.sum("sentiment").cast("long").alias("total"),
             F.count(F.lit(1)).alias("mentions"), F.count("sentiment").alias("rated"),
             F.count_if(F.col("sentiment") < 0).alias("negative"))
    )
    mixed = (F.col("_dated") > 0) & ((F.col("_dated") < F.col("mentions"))
                                     | (F.col("month") != F.col("_last")))
    return units.groupBy(
        *series_keys(mentions), "month", "total", "mentions", "rated", "negative",
        F.col("review_id").isNotNull().alias("named"), mixed.alias("mixed"),
    ).agg(F.count(F.lit(1)).alias("r"))


def tallied_cells(tallies: DataFrame) -> DataFrame:
    """``unit_cells`` of the tallied units."""
    return (
        tallies.where(F.col("named") & F.col("month").isNotNull())
        .groupBy(*series_keys(tallies), "month", "total", "mentions")
        .agg(F.sum("r").alias("r"))
    )


def tallied_months(tallies: DataFrame, mentions: DataFrame) -> DataFrame:
    """``mention_months`` of the tallied mentions, which are read again only if units are mixed."""
    if not tallies.where("mixed").isEmpty():
        return mention_months(mentions)
    r = F.col("r")
    return tallies.groupBy(*series_keys(tallies), "month").agg(
        F.sum(r * F.col("rated")).alias("n"), F.sum(r * F.col("total")).alias("total"),
        F.sum(r * F.col("negative")).alias("negative"))


def aspect_scores(mentions: DataFrame) -> DataFrame:
    """Mention-level mean sentiment and count per (property, aspect)."""
    return (
        mentions.where(F.col("property_id").isNotNull() & F.col("aspect").isNotNull())
        .groupBy(*series_keys(mentions))
        .agg((F.sum("sentiment") / F.count("sentiment")).alias("mean"),
             F.count("sentiment").alias("n"))
    )


def cluster_means(scores: DataFrame) -> DataFrame:
    """Unweighted mean of the property means, per aspect."""
    return scores.groupBy(*scope(scores), "aspect").agg(F.avg("mean").alias("cluster_mean"))


def trend(mentions: DataFrame, property_id: str | None = None,
          aspect: str | None = None) -> DataFrame:
    """Month, mean and count per series; months without a mention are absent."""
    for column, wanted in (("property_id", property_id), ("aspect", aspect)):
        if wanted is not None:
            mentions = mentions.where(F.col(column) == wanted)
    months = mention_months(mentions).where(F.col("n") > 0)
    return months.select(*series_keys(mentions), "month",
                         (F.col("total") / F.col("n")).alias("mean"), "n")


def cluster_matrix(mentions: DataFrame, aspects: list[str]) -> DataFrame:
    """Properties (natural order) x aspects (taxonomy order) of mean sentiment."""
    keys = [*scope(mentions), "property_id"]
    wide = (
        mentions.where(F.col("property_id").isNotNull()).groupBy(*keys)
        .pivot("aspect", aspects).agg(F.avg("sentiment"))
    )
    return wide.orderBy(*scope(mentions), natural_key(F.col("property_id")))


def mean_since(months: DataFrame, since: str) -> DataFrame:
    """Per aspect, the unweighted mean over properties of their mean in [since, end]."""
    own = (
        months.where(F.col("month") >= F.lit(since).cast("date"))
        .groupBy(*series_keys(months))
        .agg((F.sum("total") / F.sum("n")).alias("mean"))
    )
    return own.groupBy(*scope(months), "aspect").agg(F.avg("mean").alias("mean_since"))


def star_averages(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(*scope(reviews), "property_id").agg(
        F.avg("rating").alias("mean_rating"), F.count("rating").alias("n"))


def coverage(mentions: DataFrame) -> DataFrame:
    """Distinct properties per aspect."""
    return mentions.groupBy(*scope(mentions), "aspect").agg(
        F.count_distinct("property_id").alias("n_properties"))


def list_properties(reviews: DataFrame) -> DataFrame:
    keys = [*scope(reviews), "property_id"]
    return reviews.select(*keys).distinct().orderBy(
        *scope(reviews), natural_key(F.col("property_id")))


def date_range(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(*scope(reviews)).agg(
        F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order; ties are impossible by the order."""
    return (df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where("_rn = 1").drop("_rn"))
