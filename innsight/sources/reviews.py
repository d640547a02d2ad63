"""Review files: reading, column mapping, validation, cross-file repeats, ids."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight import config
from innsight.functions.frames import CLUSTER

SUFFIXES = (".csv", ".json", ".jsonl")


class SchemaError(ValueError):
    """Input that does not meet the review contract."""


# --- I1-I2: one file ------------------------------------------------------------------------


def read_frame(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Read one CSV, JSON array or JSON-lines export as it is; a folder of part files is one export.

    CSV columns stay text. ``multiline=False`` lets Spark split a large CSV whose quoted
    fields hold no line breaks.
    """
    kind = kind_of(str(path))
    if not kind and _is_folder(spark, str(path)):
        kind = next(map(kind_of, _entries(spark, str(path))[0]), "")  # a folder of part files
    if kind == ".csv":
        return spark.read.csv(str(path), header=True, multiLine=multiline, escape='"')
    if kind in (".json", ".jsonl"):
        return spark.read.json(str(path), multiLine=(kind == ".json"))
    raise SchemaError(f"{path}: only {', '.join(SUFFIXES)} can be read")


def kind_of(path: str) -> str:
    name = path.rstrip("/").lower()
    return next((s for s in SUFFIXES if name.endswith(s)), "")


def load_reviews(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One export, without reviewer identity, validated."""
    return _loaded(spark, [str(path)], multiline).drop(*_OWN)


_OWN = ("_export", "_place")


def _loaded(spark: SparkSession, exports: list[str], multiline: bool, shape=None) -> DataFrame:
    from innsight.sources.exports import read_exports, validated

    for path in exports:
        if not kind_of(path) and part_files(spark, path) is None:
            raise SchemaError(f"{path}: only {', '.join(SUFFIXES)} can be read")
    return validated(read_exports(spark, exports, multiline, shape))


def drop_identity_columns(df: DataFrame) -> DataFrame:
    """Remove reviewer identity before anything else; the scan never reads the columns."""
    return df.drop(*[c for c in df.columns if c.strip().lower() in config.IDENTITY_COLUMNS])


# --- I7: dates --------------------------------------------------------------------------------

_ISO = r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"
_OFFSET = r"[T ]\d{1,2}:.*(Z|[+-]\d{2}:?\d{2})$"
_MONTHS = {name[:3].lower(): i + 1 for i, name in enumerate(config.MONTH_NAMES)}
_DAY_MONTH = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(.*)$"
_NAMED = (
    (r"^(\d{1,2})[ -]([A-Za-z]{3,9})[ -](\d{4})(.*)$", (3, 2, 1, 4)),
    (r"^([A-Za-z]{3,9})[ ](\d{1,2}),?[ ](\d{4})(.*)$", (3, 1, 2, 4)),
)
_YEAR_FIRST = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(.*)$"


@dataclass(frozen=True)
class DateRule:
    """How a whole column is read: the format comes from its first value."""

    pattern: str
    order: tuple[int, int, int, int]  # capture groups of year, month, day, rest
    named_month: bool = False

    def iso(self, text: Column) -> Column:
        year, month, day, rest = (
            F.regexp_extract(text, self.pattern, i) for i in self.order)
        if self.named_month:
            table = F.create_map(*[F.lit(x) for kv in _MONTHS.items() for x in kv])
            month = F.try_element_at(table, F.lower(F.substring(month, 1, 3))).cast("string")
        joined = F.concat(year, F.lit("-"), month, F.lit("-"), day, rest)
        return F.when(text.rlike(self.pattern), joined)


#: How a column of dates can be written, by the layout's name: text to a naive local timestamp.
LAYOUTS = {
    "iso": lambda text: _iso_to_local(text),
    "year_first": lambda text: DateRule(_YEAR_FIRST, (1, 2, 3, 4)).iso(text).try_cast("timestamp_ntz"),
    "month_first": lambda text: DateRule(_DAY_MONTH, (4, 1, 3, 5)).iso(text).try_cast("timestamp_ntz"),
    "day_first": lambda text: DateRule(_DAY_MONTH, (4, 3, 1, 5)).iso(text).try_cast("timestamp_ntz"),
    "day_named": lambda text: DateRule(*_NAMED[0], named_month=True).iso(text).try_cast("timestamp_ntz"),
    "named_day": lambda text: DateRule(*_NAMED[1], named_month=True).iso(text).try_cast("timestamp_ntz"),
}


def layout_of(first: Column) -> Column:
    """The layout that a first value shows, as ``_infer_rule`` reads it; null for none."""
    return (
        F.when(first.rlike(_ISO), "iso").when(first.rlike(_YEAR_FIRST), "year_first")
        .when(first.rlike(_DAY_MONTH), F.when(F.regexp_extract(first, _DAY_MONTH, 1).cast("int") <= 12, "month_first").otherwise("day_first"))
        .when(first.rlike(_NAMED[0][0]), "day_named").when(first.rlike(_NAMED[1][0]), "named_day"))


def epoch_unit(biggest: Column) -> Column:
    """Ticks per second of a column of Unix times, by its largest magnitude."""
    return F.when(biggest < 1e11, 1).when(biggest < 1e14, 1000).when(biggest < 1e17, 1_000_000).otherwise(1_000_000_000).cast("decimal(20,1)")


def _infer_rule(first: str) -> DateRule | None:
    """None for ISO text; otherwise the layout of the first value (month first if it fits)."""
    text = first.strip()
    if re.match(_ISO, text):
        return None
    if re.match(_YEAR_FIRST, text):
        return DateRule(_YEAR_FIRST, (1, 2, 3, 4))
    found = re.match(_DAY_MONTH, text)
    if found:
        month_first = int(found.group(1)) <= 12
        return DateRule(_DAY_MONTH, (4, 1, 3, 5) if month_first else (4, 3, 1, 5))
    for pattern, order in _NAMED:
        if re.match(pattern, text):
            return DateRule(pattern, order, named_month=True)
    raise SchemaError(f"Column 'date' is not parseable as a date: {first!r}")


def _to_local(utc: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(config.LOCAL_TZ), utc)


def from_epoch(value: Column, unit: Column) -> Column:
    seconds = value.cast("decimal(38,6)") / unit
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return _to_local(start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))


def _iso_to_local(text: Column) -> Column:
    """ISO text: offsets become local wall time, naive values are kept as written."""
    body = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    sign = F.when(F.regexp_extract(text, r"([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
    hours = F.regexp_extract(text, r"[+-](\d{2}):?\d{2}$", 1).try_cast("int")
    mins = F.regexp_extract(text, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("int")
    shift = F.make_dt_interval(mins=sign * (F.coalesce(hours, F.lit(0)) * 60
                                            + F.coalesce(mins, F.lit(0))))
    utc = body.try_cast("timestamp_ntz") - shift
    return F.when(text.rlike(_OFFSET), _to_local(utc)).otherwise(
        text.try_cast("timestamp_ntz"))


def parse_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """Column as naive local timestamps: one look at the first value and one aggregate.

    Numbers are Unix epochs (unit by the column's largest magnitude). Any value that does
    not fit the column's one format is an error; nothing is guessed value by value.
    """
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    text = F.trim(F.col(column).cast("string"))
    number = F.col(column).try_cast("double")
    seen = df.agg(F.count(column).alias("n"), F.count(number).alias("numbers"),
                  F.max(F.abs(number)).alias("biggest")).first()
    if seen["n"] == 0:
        return df.withColumn(column, F.lit(None).cast("timestamp_ntz"))
    if seen["numbers"] == seen["n"]:
        value = F.col(column) if isinstance(dtype, T.IntegralType) else text.try_cast(
            "decimal(38,6)")
        return df.withColumn(column, from_epoch(value, epoch_unit(F.lit(seen["biggest"]))))
    first = df.where(F.col(column).isNotNull()).select(text.alias("t")).first()["t"]
    rule = _infer_rule(first)
    parsed = _iso_to_local(text) if rule is None else rule.iso(text).try_cast("timestamp_ntz")
    bad = df.where(F.col(column).isNotNull() & parsed.isNull()).select(text.alias("t")).first()
    if bad is not None:
        raise SchemaError(
            f"Column 'date' is not parseable as a date: {bad['t']!r} does not match {first!r}")
    return df.withColumn(column, parsed)


# --- I6: validation -----------------------------------------------------------------------------


def require_columns(df: DataFrame) -> None:
    missing = [c for c in config.REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise SchemaError(f"no column for required {', '.join(missing)}")


def _blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]")


def faults() -> dict[str, Column]:
    """What makes a row unusable, by name, in the order in which it is reported."""
    low, high = config.RATING_RANGE
    rating = F.col("rating").try_cast("double")
    return {
        "missing date": F.col("date").isNull(),
        "non-numeric rating": rating.isNull() | F.isnan(rating),
        "rating out of range": ~rating.between(low, high),
        "empty text": _blank(F.col("text").cast("string")),
    }


def validate_reviews(df: DataFrame) -> DataFrame:
    """Check a review frame with one aggregate; the error counts the rows of every fault there is."""
    require_columns(df)
    df = parse_dates(df)
    judged = faults()
    counts = df.agg(*[F.count_if(rule).alias(name) for name, rule in judged.items()]).first()
    if found := [f"{name}: {counts[name]}" for name in judged if counts[name]]:
        raise SchemaError(f"unusable reviews ({'; '.join(found)})")
    return df.withColumn("rating", F.col("rating").try_cast("double")).withColumn("text", F.col("text").cast("string"))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reason``): the form for data too large to refuse."""
    require_columns(df)
    reason = F.coalesce(*[F.when(rule, name) for name, rule in faults().items()])
    judged = df.withColumn("reason", reason)
    valid = judged.where(F.col("reason").isNull()).drop("reason")
    return (valid.withColumn("rating", F.col("rating").try_cast("double")),
            judged.where(F.col("reason").isNotNull()))


# --- I3-I4: many files ---------------------------------------------------------------------------


def _comparison_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over the typed key columns: equal reviews meet, nulls included."""
    columns = [c for c in [*config.REQUIRED_COLUMNS, "review_id"] if c in df.columns]
    cells = [F.coalesce(F.col(c).cast("double" if c == "rating" else "string").cast("string"),
                        F.lit("﷐")) for c in columns]
    return [F.xxhash64(*cells).alias("_k1"), F.xxhash64(F.lit("second"), *cells).alias("_k2")]


def drop_repeats_across_files(df: DataFrame, file_column: str = "_file",
                              dropped: Observation | None = None) -> DataFrame:
    """Drop rows that an earlier file already had; repeats inside one file stay.

    ``dropped`` observes the number of ``rows`` and of ``repeats`` among them.

    The first file of each key comes from a map-side aggregate, kept only for keys that
    several files share, so a row copied a billion times is one row of that table.
    """
    keyed = df.select("*", *_comparison_key(df))
    shared = keyed.groupBy("_k1", "_k2").agg(
        F.min(file_column).alias("_first"), F.max(file_column).alias("_last")
    ).where("_first < _last").drop("_last")
    judged = keyed.join(shared, ["_k1", "_k2"], "left").withColumn(
        "_kept", F.col("_first").isNull() | (F.col(file_column) == F.col("_first")))
    if dropped is not None:
        judged = judged.observe(dropped, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("_kept")).alias("repeats"))
    return judged.where("_kept").drop("_k1", "_k2", "_first", "_kept")


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isDirectory()


def full_path(spark: SparkSession, path: str) -> str:
    """The path with its file system, as listings write it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def part_files(spark: SparkSession, export: str) -> list[str] | None:
    """The review files of an export that is a folder; None for a file."""
    return _entries(spark, export)[0] if _is_folder(spark, export) else None


def _entries(spark: SparkSession, directory: str) -> tuple[list[str], list[str]]:
    """(review files, folders) of a folder on any Hadoop file system, sorted by path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    status = list(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
    names = [(s.getPath().toString(), s.isFile()) for s in status]
    return sorted(n for n, file in names if file and kind_of(n)), sorted(n for n, file in names if not file)


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """The exports of a folder: its review files, and its folders that are named like one.

    A folder of part files, as Spark writes it, is one export however many parts it has.
    """
    files, folders = _entries(spark, str(directory))
    if files and all(f.rsplit("/", 1)[-1].startswith("part-") for f in files):
        return [str(directory)]
    return sorted(files + [f for f in folders if kind_of(f)])


def load_dir(spark: SparkSession, directory: str, multiline: bool = True,
             dropped: Observation | None = None) -> DataFrame:
    """Every export of a folder, each by its own rules, without the rows an earlier export (by path) had.

    Files with one header are one scan; the number of jobs doesn't depend on the number of files.

    ``dropped`` observes ``rows`` before and ``repeats``, those of them that are dropped.
    """
    exports = list_files(spark, directory)
    if not exports:
        raise FileNotFoundError(f"{directory} holds no review export")
    combined = _loaded(spark, exports, multiline)
    return drop_repeats_across_files(combined, "_export", dropped).drop(*_OWN)


# --- I8-I9: partner exports -------------------------------------------------------------------


def _same_name(name: str) -> str:
    """Headers are compared without case, outer blanks, and the kind of word separator."""
    return "_".join(re.split(r"[ _-]", name.strip().lower()))


def _claims(columns: list[str], fields: list[str], mapping: dict[str, str]) -> list[tuple[str, int, str]]:
    """(field, priority, column) for every column that could serve a field: mapped, same name, known alias."""
    rows = [(f, 0, c) for f, c in mapping.items()]
    for priority, names in ((1, lambda f: (f,)), (2, lambda f: config.COLUMN_ALIASES.get(f, ()))):
        rows += [(f, priority, c) for f in fields for c in columns if _same_name(c) in {_same_name(n) for n in names(f)}]
    return rows


def map_columns(df: DataFrame, mapping: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Select an export's columns under their canonical names, and those of ``keep`` as they are.

    Each field goes to the column that claims it with the best priority; a column that is mapped, or
    serves an earlier field, claims no other. Two columns with equal claims are an error.
    """
    mapping = dict(mapping or {})
    fields = [*config.REQUIRED_COLUMNS, *config.OPTIONAL_COLUMNS, CLUSTER]
    wrong = {f"no such field: {f}" for f in mapping if f not in fields}
    wrong |= {f"no such column: {c}" for c in mapping.values() if c not in df.columns}
    wrong |= {f"column used twice: {c}" for c in mapping.values() if [*mapping.values()].count(c) > 1}
    if wrong:
        raise SchemaError("mapping: " + "; ".join(sorted(wrong)))
    claims = _claims([c for c in df.columns if c not in keep], fields, mapping)
    chosen: dict[str, str] = dict(mapping)
    for field in fields:
        open_claims = [(p, c) for f, p, c in claims if f == field and c not in chosen.values()]
        best = [c for p, c in open_claims if p == min(open_claims)[0]]
        if field not in chosen and best:
            if len(best) > 1:
                raise SchemaError(f"{field}: {' and '.join(best)} both fit; ambiguous without a mapping")
            chosen[field] = best[0]
    if absent := [f for f in config.REQUIRED_COLUMNS if f not in chosen]:
        raise SchemaError(f"no column for required {', '.join(absent)}")
    return df.select(*[F.col(f"`{chosen[f]}`").alias(f) for f in fields if f in chosen], *keep)


def adapt_frame(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Drop identity columns (before renaming), map, validate."""
    return validate_reviews(map_columns(drop_identity_columns(df), mapping))


def load_source(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, multiline: bool = True) -> DataFrame:
    """A partner's export: identity dropped before anything is renamed, columns mapped, validated."""
    from innsight.sources.exports import mapped

    return _loaded(spark, [str(path)], multiline, mapped(mapping)).drop(*_OWN)


# --- I10-I11: ids ---------------------------------------------------------------------------------


def check_review_ids(df: DataFrame) -> DataFrame:
    """Supplied ids must be unique and non-null."""
    clash = df.groupBy("review_id").agg(F.count(F.lit(1)).alias("n")).where(
        "n > 1 or review_id is null").first()
    if clash is not None:
        raise SchemaError("Column 'review_id' must be unique and non-empty "
                          "(duplicates often mean several files reuse the same ids).")
    return df


def assign_review_ids(df: DataFrame) -> DataFrame:
    """Stable ids from content: equal rows are counted and numbered 0, 1, 2, ...

    Counting first means a text posted a billion times crosses the shuffle as one row; its
    copies are laid out again in blocks. Re-running any task gives the same ids.
    """
    columns = list(df.columns)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("﷐")) for c in columns]
    counted = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    block = 100_000
    blocks = counted.withColumn("_b", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block))))
    last = F.least(F.lit(block), F.col("_n") - F.col("_b") * block)
    copies = blocks.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    number = F.col("_b") * block + F.col("_i") - 1
    return copies.withColumn("review_id", F.substring(F.sha2(F.concat_ws(
        "﷑", *cells, number.cast("string")), 256), 1, 32)).select(*columns, "review_id")


def with_review_ids(df: DataFrame) -> DataFrame:
    return check_review_ids(df) if "review_id" in df.columns else assign_review_ids(df)


def normalise_property_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("property_id", F.trim(F.col("property_id").cast("string")))


def review_columns(df: DataFrame) -> list[str]:
    keys = [CLUSTER] if CLUSTER in df.columns else []
    return [*keys, "review_id", *config.REQUIRED_COLUMNS]
