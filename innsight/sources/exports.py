"""Many review exports in one scan.

Files are grouped by their header and each group is read at once, whatever the number of files. A row knows its
export by the file's own path. What is decided per export (the layout of its dates, what is wrong with its rows) comes from aggregates
keyed by the export, so the number of Spark jobs doesn't grow with the number of files.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.functions.frames import stage
from innsight.sources import reviews as rules

#: Path of the export that a row is from, and its place in it.
EXPORT, PLACE = "_export", "_place"
#: Exports named in an error; the others are counted.
SHOWN = 20
#: With so many exports at most, their rules are broadcast (a path and four numbers each); more are joined as they measure.
BROADCAST_EXPORTS = 10_000


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in the first record of a CSV file, repeated and empty ones made distinct by their place."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        record = lines.readLine() or ""
        while record.count('"') % 2 and (more := lines.readLine()) is not None:
            record += "\n" + more
    finally:
        stream.close()
    names = next(csv.reader([record.removeprefix("﻿")]), [])
    return tuple(f"_c{i}" if not n else f"{n}{i}" if names.count(n) > 1 else n for i, n in enumerate(names))


def _files(spark: SparkSession, exports: list[str]) -> dict[str, str]:
    """{file: export}; an export that is a folder has its part files."""
    found = {}
    for export in exports:
        parts = rules.part_files(spark, export)
        found |= dict.fromkeys(parts, export) if parts is not None else {export: export}
    return found


def _own_path(path: Column | str) -> Column:
    """Local paths are written with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _groups(spark: SparkSession, files: dict[str, str], multiline: bool) -> list[DataFrame]:
    """One frame per CSV header, one for JSON arrays and one for JSON lines; a folder's name says what its parts are."""
    by_kind = defaultdict(list)
    for f, export in sorted(files.items()):
        by_kind[rules.kind_of(export) or rules.kind_of(f)].append(f)
    tables = by_kind[".csv"]
    by_header = defaultdict(list)
    with ThreadPoolExecutor(16) as pool:
        for f, header in zip(tables, pool.map(lambda f: _header(spark, f), tables), strict=True):
            by_header[header].append(f)
    frames = []
    for header, paths in sorted(by_header.items()):
        if header:  # a part without rows may lack even its header
            schema = T.StructType([T.StructField(n, T.StringType()) for n in header])
            frames.append(spark.read.csv(paths, schema, header=True, multiLine=multiline, escape='"'))
    for kind in (".json", ".jsonl"):
        if by_kind[kind]:
            frames.append(spark.read.json(by_kind[kind], multiLine=kind == ".json"))
    return frames


def read_exports(
    spark: SparkSession, exports: list[str], multiline: bool = True, shape: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """The rows of all exports as they are, without reviewer identity, with EXPORT and PLACE.

    ``shape`` changes each group of files with one header before they are put together; it is given the columns to keep. Columns that a group
    lacks are null. Defined cases: an export without a record has no rows; a column named twice gets its place behind its name.
    """
    files = _files(spark, exports)
    folders = [e for e in exports if e not in files]
    own, parent = _own_path(F.col("_metadata.file_path")), F.regexp_replace(_own_path(F.col("_metadata.file_path")), "/[^/]+$", "")
    named = spark.range(1).select(*[_own_path(F.lit(rules.full_path(spark, f))).alias(str(i)) for i, f in enumerate(folders)]).first() if folders else ()
    export = F.when(parent.isin(list(named)), parent).otherwise(own) if folders else own
    # within a file rows are numbered in their order; a file that is split is numbered from each block
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    frames = []
    for frame in _groups(spark, files, multiline):
        marked = rules.drop_identity_columns(frame.select("*", export.alias(EXPORT), place.alias(PLACE)))
        frames.append(shape(marked, [EXPORT, PLACE]) if shape else marked)
    if not frames:
        raise rules.SchemaError(f"no records in {', '.join(exports[:SHOWN])}")
    kinds = defaultdict(set)
    for frame in frames:
        rules.require_columns(frame)
        for name, kind in frame.dtypes:
            kinds[name].add(kind)
    # numbers in one export may be text in another
    mixed = {name for name, found in kinds.items() if len(found) > 1}
    frames = [f.withColumns({c: F.col(f"`{c}`").cast("string") for c in f.columns if c in mixed}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def date_rules(rows: DataFrame) -> DataFrame:
    """(EXPORT, layout, unit, first): how each export writes its dates, from its first date and one aggregate over all exports."""
    text, number = F.trim(F.col("date").cast("string")), F.col("date").try_cast("double")
    facts = rows.groupBy(EXPORT).agg(
        F.count("date").alias("n"), F.count(number).alias("numbers"), F.max(F.abs(number)).alias("biggest"),
        F.min_by(text, F.when(F.col("date").isNotNull(), F.col(PLACE))).alias("first"))
    layout = F.when(F.col("n") == 0, "none").when(F.col("numbers") == F.col("n"), "epoch").otherwise(rules.layout_of(F.col("first")))
    return stage(facts.select(EXPORT, layout.alias("layout"), rules.epoch_unit(F.col("biggest")).alias("unit"), "first"), "date-rules")


def validated(rows: DataFrame) -> DataFrame:
    """Rows with naive local ``date``, numeric ``rating`` and ``text``, or an error that counts the faults of every export that has some."""
    found = date_rules(rows)
    few = found.limit(BROADCAST_EXPORTS + 1).count() <= BROADCAST_EXPORTS
    text = F.trim(F.col("date").cast("string"))
    parsed = F.when(F.col("layout") == "epoch", rules.from_epoch(text.try_cast("decimal(38,6)"), F.col("unit")))
    for layout, parse in rules.LAYOUTS.items():
        parsed = parsed.when(F.col("layout") == layout, parse(text))
    dated = rows.join(F.broadcast(found) if few else found, EXPORT).withColumn("_written", text).withColumn("date", parsed)
    undated = F.col("_written").isNotNull() & F.col("date").isNull()
    faults = rules.faults() | {"missing date": F.col("_written").isNull()}
    counts = dated.groupBy(EXPORT).agg(
        *[F.count_if(rule).alias(name) for name, rule in faults.items()], F.count_if(undated).alias("undated"),
        F.min(F.when(undated, F.col("_written"))).alias("example"), F.first("first").alias("first"))
    bad = counts.where(" OR ".join(f"`{c}` > 0" for c in [*faults, "undated"])).orderBy(EXPORT).limit(SHOWN).collect()
    if bad:
        raise rules.SchemaError("; ".join(_complaint(r, list(faults)) for r in bad))
    return dated.drop("_written", "layout", "unit", "first").withColumn(
        "rating", F.col("rating").try_cast("double")).withColumn("text", F.col("text").cast("string"))


def _complaint(row, faults: list[str]) -> str:
    said = [f"{name}: {row[name]}" for name in faults if row[name]]
    if row["undated"]:
        said.append(f"Column 'date' is not parseable as a date in {row['undated']} rows: {row['example']!r} does not match {row['first']!r}")
    return f"{row[EXPORT].rsplit('/', 1)[-1]}: unusable reviews ({'; '.join(said)})"


def mapped(mapping: dict[str, str] | None) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Canonical names for each group of files."""
    return lambda frame, keep: rules.map_columns(frame, mapping, keep)


def export_sizes(rows: DataFrame) -> DataFrame:
    """(export, reviews): what each export brought."""
    return rows.groupBy(F.element_at(F.split(EXPORT, "/"), -1).alias("export")).agg(F.count(F.lit(1)).alias("reviews"))
