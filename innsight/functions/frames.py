"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CLUSTER = "cluster_id"


def scope(df: DataFrame) -> list[str]:
    """The optional many-clusters key: every family and market is computed within it."""
    return [CLUSTER] if CLUSTER in df.columns else []


def attach(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-(aspect, month)-like totals back to their rows.

    Without a cluster key the totals have at most taxonomy x calendar months rows, so they
    are broadcast. With one they grow with the number of clusters and the join is left to
    the runtime, which broadcasts only a side it has measured and splits skewed partitions.
    """
    if not on:
        return df.crossJoin(F.broadcast(small))  # one row: a global aggregate
    return df.join(small if CLUSTER in on else F.broadcast(small), list(on), how)


def unnest(df: DataFrame, keep: Sequence[str], array: Column) -> DataFrame:
    """One row per struct in ``array``, with ``keep``; empty and null arrays give none.

    The outer form keeps the optimizer from adding a "not empty" filter, which would be
    pushed down and compute an expensive array expression once more per condition.
    """
    rows = df.select(*keep, F.explode_outer(array).alias("_x"))
    return rows.where(F.col("_x").isNotNull()).select(*keep, "_x.*")


def month_of(date: Column) -> Column:
    return F.trunc(date.cast("date"), "MM")


def month_label(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def half_even(value: Column, digits: int) -> Column:
    """Rounded to ``digits`` decimals, ties decided on the exact binary value and then to even."""
    value = value.cast("double")
    exact = _nearest_integer(value, 10.0 ** digits) / F.lit(10.0 ** digits)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(exact)


def _nearest_integer(value: Column, scale: float) -> Column:
    """value * scale to the nearest integer, ties decided on the exact binary value.

    Splitting the value in two halves makes the product exact, so 0.945 (stored slightly
    below) becomes 94 and not 95 at two decimals; true ties go to the even neighbour.
    """
    big = value * F.lit(134217729.0)
    high = big - (big - value)
    low = value - high
    product = value * F.lit(scale)
    error = (high * F.lit(scale) - product) + low * F.lit(scale)
    base = F.floor(product).cast("double")
    over = (product - base - 0.5) + error
    odd = F.pmod(base, F.lit(2.0)) == 1
    return base + F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(odd.cast("double"))


def decimals(value: Column, digits: int = 2, signed: bool = False) -> Column:
    """Fixed-point text of a double, correctly rounded."""
    shown = _nearest_integer(value, 10.0 ** digits) / F.lit(10.0 ** digits)
    return F.format_string(f"%{'+' if signed else ''}.{digits}f", shown)


def phrase(template: str, **parts: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column; null if one of those is null."""
    return F.concat(*[parts[piece].cast("string") if named else F.lit(piece)
                      for named, piece in _pieces(template) if piece])


def _pieces(template: str) -> list[tuple[bool, str]]:
    return [(at % 2 == 1, piece) for at, piece in enumerate(re.split(r"\{(\w+)\}", template))]


def natural_key(name: Column) -> Column:
    """Sort key that puts 'Property 2' before 'Property 10'."""
    digits = F.regexp_replace(F.lower(name), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(digits, r"0*(\d{20})(?!\d)", "$1")


def taxonomy_rank(aspect: Column, aspects: Sequence[str]) -> Column:
    rank = F.array_position(F.lit(list(aspects)), aspect)
    return F.when(rank > 0, rank).otherwise(len(aspects) + 1)


_STAGED: list[str] = []


def staging_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="innsight-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by ``drop_staged``."""
    path = f"{staging_folder(spark)}/innsight-{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write a small table that several branches read to the shared checkpoint folder.

    A written table cuts lineage, survives lost executors, is computed once, and gives later
    joins a measured size.
    """
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables staged by this process; call it when their readers are done."""
    jvm, count = spark._jvm, 0
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        count += 1
    return count
