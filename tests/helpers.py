"""Seeded review series drawn inside Spark, so any size is reproducible."""

from pyspark.sql import functions as F


def series(spark, rates, months=24, per_month=15, aspect="Food", first="2024-01-01", seed=1):
    """One +1/-1 mention per review. ``rates`` maps property -> f(month index) -> P(+1)."""
    frames = None
    for prop, rate in rates.items():
        table = [(prop, i, float(rate(i))) for i in range(months)]
        plan = spark.createDataFrame(table, "property_id string, m int, p double")
        frames = plan if frames is None else frames.unionByName(plan)
    rows = frames.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_month))))
    draw = F.pmod(F.xxhash64(F.lit(seed), "property_id", F.lit(aspect), "m", "k"),
                  F.lit(1_000_003)) / 1_000_003.0
    return rows.select(
        F.concat_ws("-", "property_id", F.lit(aspect), "m", "k").alias("review_id"), "property_id",
        F.date_add(F.add_months(F.lit(first).cast("date"), F.col("m")),
                   F.col("k") % 27).alias("date"),
        F.lit(aspect).alias("aspect"),
        F.when(draw < F.col("p"), 1).otherwise(-1).alias("sentiment"),
        F.lit("x").alias("sentence"))


def flat(p):
    return lambda i: p


def step(before, after, at):
    return lambda i: before if i < at else after
