"""Exact dedup over a persistent digest index (operator 8): DataFrame functions only.

The index is a table of one row per distinct text, bucketed and sorted by digest. A new
batch is reduced to one row per digest first (map-side, so a group of copies of any size
is a handful of rows), the rows whose digest the index has are removed by a sort-merge
anti-join that reads the index without a shuffle, and the rest is appended.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.common import SPACE, by_content, kept_rows, new_path, row_of, text_or_empty, written
from innsight.llm.components import attach

_SCHEMA = "digest BINARY, keep_id BIGINT, batch STRING"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; case and edges stay."""
    return F.regexp_replace(text, SPACE, " ")


@dataclass(frozen=True)
class DigestIndex:
    """Digests seen so far, each with the id of the row that stays and the batch that brought it."""

    spark: SparkSession
    table: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = 64) -> DigestIndex:
        """The index stored at ``path``, made empty if there is none.

        ``buckets`` is fixed for the life of an index. The catalog entry is made anew in
        each session, so an index outlives the session that wrote it.
        """
        table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return cls(spark, table, buckets)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def before(self, batch: str) -> DataFrame:
        """What other batches brought. A batch that is run again, after a crash or on purpose, isn't held against itself."""
        return self.read().where(F.col("batch") != batch)

    def unseen(self, firsts: DataFrame, batch: str) -> DataFrame:
        """Rows of ``firsts`` (one per digest) whose digest no other batch brought."""
        return firsts.join(self.before(batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, firsts: DataFrame, batch: str) -> None:
        """Add rows (digest, keep_id) that the index lacks, of this batch too; one file per bucket, sorted."""
        new = firsts.select("digest", "keep_id").join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self._add(written(new.withColumn("batch", F.lit(batch)), "digest-new"))  # not read from what it writes to

    def compacted(self, path: str) -> DigestIndex:
        """A copy at a new ``path`` with one sorted file per bucket, so that reads need no sort after many appends.

        The old index stays until its owner deletes it; a copy that was broken off is started anew at another path.
        """
        copy = DigestIndex.open(self.spark, path, self.buckets)
        copy._add(self.read())
        return copy

    def _add(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest")
            .format("parquet").mode("append").saveAsTable(self.table)
        )

    def forget(self) -> None:
        """Drop the catalog entry; the files stay, and ``open`` finds them again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_dedup(docs: DataFrame, index: DigestIndex, row: str | None = None, batch: str | None = None) -> DataFrame:
    """Deduplicate a batch against itself and ``index``, and append its new texts.

    A caller who may have to repeat a batch names it: the same ``batch`` with the same rows gives the same result again, whether or
    not the first attempt reached the index. Without a name each call is a batch of its own.

    Returns one row per row of ``docs``: doc_id, keep_id, group_size (rows of this batch
    with that text), kept, text_sha256, and row if ``row`` names a column of row numbers. The row that
    stays is the one the index holds, else the smallest doc_id of the batch. Defined
    cases: a null text is empty; a null doc_id comes after every other, and keep_id is null
    only if the whole group has none; of rows equal in text and doc_id exactly one is kept;
    an empty batch gives no rows; other columns of ``docs``, whatever their names, are left out.
    """
    own = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.sha2(normalised(text_or_empty(docs)), 256).alias("text_sha256"),
        row_of(docs, row),
    )
    own = written(own.withColumn("digest", F.unhex("text_sha256")), "digests")

    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    groups = written(
        own.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "group_size", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row")),
        "digest-groups",
    )
    batch = batch or uuid.uuid4().hex
    new = written(index.unseen(groups, batch).select("digest", F.col("first_id").alias("keep_id")), "digest-unseen")
    seen = groups.join(new.select("digest"), "digest", "left_anti").join(
        index.before(batch).withColumnRenamed("keep_id", "seen_id"), "digest"
    )
    decided = groups.join(seen.select("digest", "seen_id", F.lit(True).alias("seen")), "digest", "left").select(
        "digest", "group_size", F.when(F.col("seen"), F.col("seen_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.when(F.col("seen"), F.lit(-1)).otherwise(F.col("first_row")).alias("keep_row"),
    )
    out = attach(own, written(decided, "digest-decided"), "digest", "group_size").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", *["row"] * bool(row)
    )
    index.append(new, batch)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row has, by a new index.

    Defined cases as in ``exact_dedup``; all columns stay, whatever their names, and of rows equal in all of them one stays.
    """
    rows = by_content(docs)
    index = DigestIndex.open(docs.sparkSession, new_path(docs.sparkSession, "digest-index"))
    out = kept_rows(rows, exact_dedup(rows.select("row", "document.doc_id", "document.text"), index, "row"))
    index.forget()  # what is kept has been decided and written
    return out


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as one batch against a new index."""
    index = DigestIndex.open(spark, new_path(spark, "digest-index"))
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), index)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256 AS text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
