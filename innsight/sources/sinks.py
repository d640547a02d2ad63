"""Exports: snapshots published as a whole, JSON and CSV files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from innsight.functions.frames import stage
from innsight.functions.geo import coarsen


def write_json(df: DataFrame, path: str, partition_by: str | None = None, rows_per_file: int = 0) -> None:
    """JSON lines with explicit nulls (NaN becomes null)."""
    clean = df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes])
    writer = clean.write.option("ignoreNullFields", "false").option("maxRecordsPerFile", rows_per_file).mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and doubled quotes, as spreadsheets expect."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def public_locations(locations: DataFrame, is_synthetic: bool) -> DataFrame:
    """Exact positions only for synthetic data; anything else is snapped to a grid."""
    return locations if is_synthetic else coarsen(locations)


#: Tables that are read by property: their rows lie together, in files of a bounded number of rows.
PER_PROPERTY = {"scorecards", "priorities", "trends", "changepoints", "reviews", "mentions", "fix_checks"}
ROWS_PER_FILE = 200_000
MANIFEST = "manifest.json"


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a file beside ``path`` and rename it over it: a reader finds the old text or the new."""
    draft, system = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(draft)
    body = text.encode()
    stream.write(body, 0, len(body))
    stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options
    over = spark._sc._gateway.new_array(options.Rename, 1)
    over[0] = options.Rename.OVERWRITE
    target = system.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(draft), target, over)


def by_property(df: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rows dealt so that a property is in as few files as its rows need, and no task gets more than about ``rows_per_file`` of one."""
    df = stage(df, "per-property")  # read twice: counted, then dealt
    counts = stage(df.groupBy("property_id").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files")), "property-files")
    large = counts.where("_files > 1")  # at most rows / rows_per_file of them
    salted = df.join(large, "property_id", "left").withColumn(
        "_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_files", F.lit(1)).cast("bigint")))
    return salted.repartition("property_id", "_salt").drop("_files", "_salt")


def snapshot_meta(reviews: DataFrame) -> dict[str, Column]:
    """What a snapshot says of its reviews, as aggregates that ride along with their write."""
    return {
        "n_reviews": F.count(F.lit(1)), "date_min": F.date_format(F.min("date"), "yyyy-MM-dd"), "date_max": F.date_format(F.max("date"), "yyyy-MM-dd"),
    }


def write_snapshot(tables: dict[str, DataFrame], folder: str, info: dict | None = None, rows_per_file: int = ROWS_PER_FILE) -> list[str]:
    """Write all tables and then publish them at once.

    Each call writes to a run folder of its own, which no reader knows; the manifest, renamed into place when every table is
    complete, names the run, its tables with their numbers of rows, and the meta data (``info`` and what the reviews tell, observed while they are
    written). A call that fails leaves the snapshot before it as it was. Per-property tables are sorted by property within files of at most ``rows_per_file`` rows.
    """
    spark = next(iter(tables.values())).sparkSession
    run = f"run-{uuid.uuid4().hex}"
    about, meta = {}, dict(info or {})
    for name, df in tables.items():
        seen = Observation()
        facts = snapshot_meta(df) if name == "reviews" else {}
        dealt = by_property(df, rows_per_file).sortWithinPartitions("property_id") if name in PER_PROPERTY else df
        dealt = dealt.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in facts.items()])
        write_json(dealt, f"{folder}/{run}/{name}", rows_per_file=rows_per_file)
        found = seen.get
        about[name] = {"rows": found["rows"], "schema": df.schema.json()}
        meta |= {k: found[k] for k in facts}
    _replace_file(spark, f"{folder}/{MANIFEST}", json.dumps({"run": run, "tables": about, "meta": meta}, ensure_ascii=False, sort_keys=True))
    return sorted(tables)


def manifest(spark: SparkSession, folder: str) -> dict:
    """The published run, its tables and meta data."""
    return json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/{MANIFEST}").collect()))


def read_snapshot(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the published run, with the types it was written from."""
    found = manifest(spark, folder)
    schema = StructType.fromJson(json.loads(found["tables"][table]["schema"]))
    return spark.read.schema(schema).json(f"{folder}/{found['run']}/{table}")
