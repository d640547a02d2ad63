"""Per-hotel review files whose name carries town, district and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight import config
from innsight.functions.text import normalise


def place_of(stem: Column) -> dict[str, Column]:
    """town, district, state parsed from 'Hotel-Town_District_District_State'.

    States may be cut short (a unique prefix of four or more letters); the longest matching
    district wins.
    """
    place = F.substring_index(stem, "-", -1)
    left = F.substring_index(place, "_District_", 1)
    cut = F.when(F.contains(place, F.lit("_District_")),
                 F.regexp_replace(place, "^.*?_District_", ""))
    states = F.filter(F.lit(list(config.REGION_STATES)), lambda k: (k == cut) | (
        (F.length(cut) >= 4) & F.startswith(k, cut)))
    names = F.create_map(*[F.lit(x) for kv in config.REGION_STATES.items() for x in kv])
    state = F.when(F.size(states) == 1, F.try_element_at(names, F.try_element_at(
        states, F.lit(1))))
    longest = F.lit(sorted(config.REGION_DISTRICTS, key=len, reverse=True))
    district = F.try_element_at(F.filter(longest, lambda d: (left == d) | F.endswith(
        left, F.concat(F.lit("_"), d))), F.lit(1))
    town = F.regexp_replace(F.substr(
        left, F.lit(1), F.length(left) - F.length(district)), "_+$", "")
    spaced = {"town": F.when(town == "", district).otherwise(town), "district": district}
    complete = state.isNotNull() & district.isNotNull()
    return {**{k: F.when(complete, F.replace(v, F.lit("_"), F.lit(" ")))
               for k, v in spaced.items()},
            "state": F.when(complete, state)}


def stars_of(rating: Column) -> Column:
    """10-50 in the export, 1-5 stars here."""
    stars = F.bround(rating.try_cast("double") / 10).cast("int")
    return F.when(stars.between(1, 5), stars)


def weak_label(stars: Column) -> Column:
    return F.when(stars <= 2, -1).when(stars == 3, 0).otherwise(1)


def read_hotel_files(spark: SparkSession, folder: str) -> DataFrame:
    """review, rating, file name and a within-file row order; reviewers are never read."""
    raw = spark.read.csv(folder, header=True, multiLine=True, escape='"',
                         recursiveFileLookup=True, pathGlobFilter="*.csv")
    name = F.try_url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return raw.select(
        F.col("review"), F.col("rating"),
        F.regexp_replace(name, r"\.csv$", "").alias("stem"),
        F.struct(F.col("_metadata.file_path").alias("path"),
                 F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("place_in_file"))


def prepare_region(raw: DataFrame) -> DataFrame:
    """Hill-district reviews with stars, weak label and an opaque hotel id.

    Needs review, rating, stem and place_in_file. Copies of one normalised text collapse in
    a map-side aggregate that keeps the first by file and row.
    """
    hill = hill_reviews(raw)
    kept = ["text", "stars", "label", "hotel", "town", "district", "state"]
    usable = (
        hill.withColumn("stars", stars_of(F.col("rating")))
        .withColumn("text", F.col("review"))
        .where(F.col("text").isNotNull() & F.col("stars").isNotNull()
               & F.col("text").rlike(r"\S"))
        .withColumn("label", weak_label(F.col("stars")))
        .withColumn("hotel", F.concat(F.lit("H"), F.substring(F.sha2("stem", 256), 1, 8)))
    )
    return (
        usable.groupBy(normalise(F.col("text")).alias("norm"))
        .agg(F.min_by(F.struct(*kept), "place_in_file").alias("_row")).select("_row.*"))


def hill_reviews(raw: DataFrame) -> DataFrame:
    placed = raw.withColumns(place_of(F.col("stem")))
    return placed.where(F.col("state").isNotNull()
                        & ~F.col("district").isin(config.PLAINS_DISTRICTS))


def region_report(raw: DataFrame, prepared: DataFrame) -> DataFrame:
    """Row counts after each step, in one row."""
    placed = raw.withColumns(place_of(F.col("stem")))
    known = F.col("state").isNotNull()
    before = placed.agg(
        F.count_if(known).alias("rows_read"),
        F.count_if(known & ~F.col("district").isin(config.PLAINS_DISTRICTS))
        .alias("rows_after_hill_filter"),
        F.count_distinct(F.when(~known, F.col("stem"))).alias("unparsed_files"))
    after = prepared.agg(F.count(F.lit(1)).alias("rows_after_dedup"),
                         F.count_distinct("hotel").alias("hotels"))
    return before.crossJoin(after)  # one row each


def prepare_folder(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_region(read_hotel_files(spark, folder))
