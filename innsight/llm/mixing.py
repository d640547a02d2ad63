"""Mixing sources to target weights by weighted fair queueing (operator 7).

Every document of a source waits in a shuffled queue and has a virtual finish time: the
words its source has sent up to and with it, divided by the source's target. The source
that is furthest behind its target has the smallest next time, so sorting all copies by
finish time interleaves the sources in proportion; the mix ends where the word budget ends.
A source whose target exceeds its size is queued again, up to ``MAX_EPOCHS`` times.

No source is ever gathered: queues are cut in hash ranges of about ``RANGE_ROWS`` rows and
the global order in ranges of virtual time, each with its words summed first; only the
totals of the ranges are added up in sequence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from innsight.llm.common import by_content, documents, row_of, text_or_empty, written

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
RANGE_ROWS = 5_000
_HASH_SPAN = 1 << 48


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that aren't white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def water_level(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets for (source, source_size): shares by weight, none above MAX_EPOCHS x its size.

    Capped sources are those with the smallest cap per weight; the level of the others is
    what the capped ones leave, per unit of weight. One row per source is sorted here; the
    number of sources, not of documents, bounds it.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(named) - 1
    ranked = sources.withColumn("weight", F.element_at(F.lit(list(weights)), (rank % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(MAX_EPOCHS) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("level", F.when(F.col("cap") > F.col("weight") * level, level))
    # the first source that isn't capped sets the level of all
    levelled = levelled.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.col("weight") * F.col("level")
    return levelled.select(
        "source", "source_size",
        F.when(F.col("level").isNull() | (F.col("cap") <= share), F.col("cap").cast("double")).otherwise(share).alias("target"),
    )


def queue_hash(doc_id: Column) -> Column:
    """A fixed shuffle: 48 bits of the md5 of the id as text (null: empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("bigint")


def _source_key(source: Column) -> Column:
    """A join key that is never null: the null source is the empty text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, row: str | None = None) -> DataFrame:
    """Each document with its size, target and ``sent``: the words its source has sent with it in one epoch."""
    own = written(
        docs.select(
            docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"),
            word_count(text_or_empty(docs)).alias("size"), queue_hash(docs["doc_id"]).alias("h"),
            row_of(docs, row),
        ).withColumn("key", _source_key(F.col("source"))),
        "mix-sizes",
    )
    stats = own.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    stats = written(stats, "mix-sources")
    targets = water_level(stats.select("source", "source_size"), weights)
    targets = targets.withColumn("key", _source_key(F.col("source"))).drop("source").join(stats.select("key", "n_rows"), "key")
    own = own.join(written(targets, "mix-targets"), "key")
    own = own.withColumn("part", F.floor(F.col("h") / F.lit(float(_HASH_SPAN)) * F.ceil(F.col("n_rows") / RANGE_ROWS)))

    # words before each hash range of each source: one row per RANGE_ROWS documents
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("key", "part").agg(F.sum("size").alias("words"))
    starts = starts.select("key", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    # id and size decide among equal hashes: rows equal in both are interchangeable
    inside = Window.partitionBy("key", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("inside", F.sum("size").over(inside)).join(starts, ["key", "part"])
    return own.select("doc_id", "source", "size", "h", "source_size", "target", (F.col("start") + F.col("inside")).alias("sent"), "row")


def order_key(epoch: Column) -> Column:
    """Place of a document's copy (epochs count from 0) in the mix; it starts with the virtual finish time."""
    finish = (epoch * F.col("source_size") + F.col("sent")).cast("double") / F.col("target")
    return F.struct(
        finish.alias("finish"), F.col("source").isNull().alias("no_source"), F.col("source"), F.col("h"),
        F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.col("size"), epoch.alias("epoch"),
    )


def last_taken(queue: DataFrame) -> Column | None:
    """The order key at which the budget, the words of all documents, ends; None if nothing fits.

    Between the virtual times 0 and 1 the sources send the budget at an even rate, so equal steps
    of time cut the global order in even ranges. Their totals show where the budget ends, and
    only that range is sorted to its last word. Copies equal in the whole key are taken together.
    """
    total, n = queue.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not total:
        return None
    epoch = F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))).alias("epoch")
    copies = queue.where("size > 0").select("doc_id", "source", "size", "h", "source_size", "target", "sent", epoch)
    copies = copies.select("size", order_key(F.col("epoch")).alias("place"))
    slot = F.floor(F.col("place.finish") * max(1, math.ceil(n / RANGE_ROWS)))
    every = copies.withColumn("slot", slot)
    totals = every.groupBy("slot").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("slot"))
    ends = totals.withColumn("upto", upto).where(F.col("upto") > total).orderBy("slot").first()
    if ends:
        before = ends["upto"] - ends["words"]
        edge = every.where(F.col("slot") == ends["slot"])
        within = edge.withColumn("upto", F.lit(before) + F.sum("size").over(Window.partitionBy("slot").orderBy("place")))
        last = within.where(F.col("upto") <= total).agg(F.max("place")).first()[0]
        if last is None:  # the range's first copy is over the budget: the mix ends with the ranges before it
            last = every.where(F.col("slot") < ends["slot"]).agg(F.max("place")).first()[0]
    else:
        last = every.agg(F.max("place")).first()[0]
    return None if last is None else _literal(last)


def _literal(place) -> Column:
    kinds = ("double", "boolean", "string", "bigint", "bigint", "bigint", "int")
    names = ("finish", "no_source", "source", "h", "id", "size", "epoch")
    return F.struct(*[F.lit(v).cast(kind).alias(name) for v, kind, name in zip(place, kinds, names, strict=True)])


def taken_epochs(queue: DataFrame) -> DataFrame:
    """``queue`` with ``epochs``, the list of epochs in which the mix takes the document."""
    last = last_taken(queue)
    if last is None:
        return queue.withColumn("epochs", F.array().cast("array<int>"))
    fits = [F.when((F.col("size") > 0) & (order_key(F.lit(e)) <= last), F.lit(e)) for e in range(MAX_EPOCHS)]
    return queue.withColumn("epochs", F.array_compact(F.array(*fits)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, row: str | None = None) -> DataFrame:
    """The mix: one row per taken copy, with doc_id, source, size, source_size, target, epoch, place, finish
    and row, the number in column ``row`` if that is given.

    Sort by ``place`` for the sequence itself. Copies are taken in that order while their words
    fit in the budget. Defined cases: a null text has size 0; a document without words is
    never taken, as it changes no total; the null source is one source, after all others; a null
    doc_id is an id before all others; rows equal in source, id and size are interchangeable and
    taken alike; an empty table gives no rows. Other columns are left out.
    """
    queue = taken_epochs(written(queued(docs, weights, row), "mix-queue"))
    copies = queue.select("*", F.explode("epochs").alias("epoch"))
    place = order_key(F.col("epoch"))
    return copies.select(
        "doc_id", "source", "size", "source_size", "target", "epoch", place.alias("place"), place["finish"].alias("finish"), "row",
    )


def source_ends(queue: DataFrame) -> DataFrame:
    """(key, n_epochs, end) by source: its whole epochs in the mix, and the first place (h, id, size) of its queue that the next lacks.

    A source's copies are taken in the order of its queue, so one place per source says which of its documents are taken how often.
    Rows equal in id and size are one place: all of them are taken or none.
    """
    last = last_taken(queue)
    place = F.struct("h", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "size")
    queue = queue.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))).alias("epoch"))
    left = queue.where(F.lit(True) if last is None else order_key(F.col("epoch")) > last)
    ends = left.groupBy(_source_key(F.col("source")).alias("key")).agg(F.min(F.struct("epoch", place.alias("end"))).alias("first"))
    return ends.select("key", F.col("first.epoch").alias("n_epochs"), F.col("first.end").alias("end"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The taken copies as rows of ``docs``, in no order: a document taken in two epochs is there twice.

    Rows stay where they are: each is held against the end of its source's queue. Defined cases as in ``mix``; all columns
    stay, whatever their names; repeated rows are all taken or none.
    """
    rows = by_content(docs)
    narrow = rows.select("document.doc_id", "document.source", "document.text")
    ends = written(source_ends(written(queued(narrow, weights), "mix-queue")), "mix-ends")
    if ends.count() <= RANGE_ROWS:
        ends = F.broadcast(ends)  # so many sources at most; more are joined as they measure
    text, doc_id = F.coalesce(F.col("document.text").cast("string"), F.lit("")), F.col("document.doc_id")
    place = F.struct(
        queue_hash(doc_id).alias("h"), F.coalesce(doc_id.cast("bigint"), F.lit(-(1 << 63))).alias("id"), word_count(text).alias("size"))
    placed = rows.select("document", _source_key(F.col("document.source").cast("string")).alias("key"), place.alias("place"))
    placed = placed.where("place.size > 0").join(ends, "key", "left")
    times = F.when(F.col("n_epochs").isNull(), MAX_EPOCHS).otherwise(F.col("n_epochs") + (F.col("place") < F.col("end")).cast("int"))
    return placed.select("document", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("document.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document of ``documents``."""
    queue = taken_epochs(written(queued(documents(spark, sf_dir)), "mix-queue"))
    return queue.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("epochs")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 3 * source_size AS cap,
         1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight
  FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w
), v AS (
  SELECT arg_min(level, cap / weight) AS level FROM l WHERE cap > weight * level
), t AS (
  SELECT source, source_size,
         CASE WHEN v.level IS NULL OR cap <= weight * v.level THEN CAST(cap AS DOUBLE) ELSE weight * v.level END AS target
  FROM w LEFT JOIN v ON true
), q AS (
  SELECT d.doc_id, d.source, d.size, d.h, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, e.epoch, CAST(e.epoch * source_size + sent AS DOUBLE) / target AS finish
  FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS epoch) e WHERE size > 0
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, h, doc_id NULLS FIRST, size, epoch) AS upto FROM c
), k AS (
  SELECT doc_id, source, h, size, count(*) AS copies FROM r
  WHERE upto <= (SELECT sum(size) FROM d) GROUP BY ALL
)
SELECT q.doc_id AS doc_id, q.size AS size, q.source_size AS source_size, q.target AS target,
       CAST(q.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.source IS NOT DISTINCT FROM k.source AND q.size = k.size
"""
