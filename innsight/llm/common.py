"""Helpers shared by the operators: the shared folder, written tables and fixed expressions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Text handled at once in a Python task, whatever the number of rows in an Arrow batch.
SLICE_BYTES = 1 << 20


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="innsight-llm-"))
    return _OWN_FOLDER[0]


_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has; within ``temporary`` it is deleted at the end."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete what is written inside to the shared folder; leave when what was made of it has been written in turn.

    If the work fails its tables stay, for whoever wants to see them.
    """
    first = len(_WRITTEN)
    yield
    while len(_WRITTEN) > first:
        delete(spark, _WRITTEN.pop())


def by_content(docs: DataFrame) -> DataFrame:
    """(row, document): all columns as one, and a hash of them all. It tells rows apart like a row number, but needs no copy of the table."""
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    each = [x for c in columns for x in (c.isNull(), c)]  # a hash passes over nulls
    return docs.select(F.xxhash64(*each).alias("row"), F.struct(*columns).alias("document"))


def kept_rows(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The documents of ``rows``, as ``by_content`` gives them, that ``decided`` (doc_id, row, kept) keeps.

    What is dropped is joined, not what stays: few narrow rows, which may be broadcast if they measure small. The hash tells rows
    of one id apart, so no two documents with ids of their own are ever taken for each other. Of rows equal in every column one stays.
    """
    keys = decided.groupBy("doc_id", "row").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    keys = written(keys.where("copies > 1 OR NOT kept"), "decided")
    own = rows.withColumn("id", F.col("document.doc_id").cast("bigint"))

    def of(those: DataFrame, how: str) -> DataFrame:
        those = those.select("doc_id", F.col("row").alias("key"))
        return own.join(those, own["id"].eqNullSafe(those["doc_id"]) & (own["row"] == those["key"]), how)

    equal = keys.where("kept")
    if equal.limit(1).count() == 0:
        return of(keys, "left_anti").select("document.*")
    return of(keys, "left_anti").unionByName(of(equal, "left_semi").dropDuplicates(["id", "row"])).select("document.*")


def row_of(docs: DataFrame, row: str | None) -> Column:
    """The row number in column ``row``, or a new one, which holds once it is written."""
    return docs[row].cast("bigint").alias("row") if row else F.monotonically_increasing_id().alias("row")


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``SLICE_BYTES`` of ``column``, one row at least."""
    start, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
