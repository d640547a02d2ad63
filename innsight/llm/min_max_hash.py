"""Near-duplicate detection by min-max hashing (operator 11).

A document's set is hashed under each permutation once, and both the least and the greatest value are kept: two
signature values for one evaluation, each equal in two sets with the probability of their Jaccard similarity, and with
less variance than two minima, as the two can't be told by the same n-gram twice. Values are banded: ``BAND_VALUES`` minima make a
bucket, and the maxima of the same permutations another. A pair of similarity s meets in no bucket with probability of at most
(1 - s ** BAND_VALUES) ** (2 * PERMUTATIONS / BAND_VALUES), 1e-11 at 0.8; every link is confirmed on full sets.

Buckets aren't opened into pairs:

1. Each bucket has a leader, the least of its sets in one order for all buckets. Sets that share several buckets with a leader are
   compared with it alone, so a group of near copies is tied in a number of comparisons that grows with its size.
2. Buckets within one component are done. Of the others, whole clusters are compared in blocks of bounded size as products of their
   incidence matrices; a cluster too large for that is compared bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.common import documents, row_of, slices, text_or_empty, written
from innsight.llm.components import attach, connected
from innsight.llm.ngram_join import LINK, LINK_OF, _blocks, _links_of_cell
from innsight.llm.word_hashes import Words, mixed, words

NGRAM = 2
PERMUTATIONS, BAND_VALUES = 96, 4
#: Sets are compared with a leader if they share so many buckets that it leads. It only decides how a pair is found.
LED_BUCKETS = 4
LEADER_ROUNDS = 2
#: Sets of a task that compares with leaders, and of a cluster that is compared whole; larger ones go bucket by bucket.
BIN_SETS, WHOLE_CLUSTER = 500, 24_000
#: N-grams that are hashed at once.
CHUNK = 4096

_draw = np.random.default_rng(2)
# odd factors and any shifts permute the 64-bit numbers
_FACTORS = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, distinct n-gram hashes, set signature) of each text that has a word."""
    table: Words = words(texts, lower=True)
    for row in range(len(texts)):
        first, n = table.first[row], table.first[row + 1] - table.first[row]
        if n:
            grams = np.unique(table.runs(np.arange(first, first + max(1, n - NGRAM + 1)), min(n, NGRAM)))
            yield row, grams, int(mixed(grams).sum(dtype=np.uint64).view(np.int64))


def min_max(grams: np.ndarray) -> np.ndarray:
    """The least value under each permutation, then the greatest of the same."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max), np.zeros(PERMUTATIONS, np.uint64)
    for s in range(0, len(grams), CHUNK):
        values = grams[s:s + CHUNK, None] * _FACTORS + _SHIFTS
        np.minimum(low, values.min(0), out=low)
        np.maximum(high, values.max(0), out=high)
    return np.concatenate([low, high])


def buckets(signature: np.ndarray) -> np.ndarray:
    """One hash per band of a signature, different for each place of the band."""
    bands = signature.reshape(-1, BAND_VALUES)
    place = np.arange(1, len(bands) + 1, dtype=np.uint64)
    return mixed((mixed(bands) * _FACTORS[:BAND_VALUES]).sum(1, dtype=np.uint64) + place * _FACTORS[-1]).view(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and signature of each document, and the buckets of sets that the task sees first."""
    seen: set[int] = set()
    for batch in chain.from_iterable(slices(b, "text") for b in batches):
        sizes, marks = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        found: list[np.ndarray | None] = [None] * batch.num_rows
        for row, grams, mark in shingle_sets(batch.column("text")):
            sizes[row], marks[row] = len(grams), mark
            if mark not in seen:
                seen.add(mark)
                found[row] = buckets(min_max(grams))
        known = [batch.column(c) for c in ("row", "doc_id", "text_hash")]
        yield pa.RecordBatch.from_arrays(
            [*known, pa.array(sizes), pa.array(marks), pa.array(found, pa.list_(pa.int64()))], ["row", "doc_id", "text_hash", "n_shingles", "mark", "buckets"])


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the equal texts of a task the first, so that copies don't all move."""
    seen: set[int] = set()
    for batch in batches:
        hashes = batch.column("text_hash").to_pylist()
        first = [not (h in seen or seen.add(h)) for h in hashes]
        yield batch.filter(pa.array(first, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chain.from_iterable(slices(b, "text") for b in batches):
        nodes = batch.column("node").to_pylist()
        found = [(mark, len(grams), grams.tobytes()) for row, grams, mark in shingle_sets(batch.column("text")) if mark == nodes[row]]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["node", "n", "grams"])


def sets_of(texts: DataFrame, measured: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, grams) of the sets in ``nodes``, written; one text of each set is read again."""
    one = measured.where("buckets IS NOT NULL").groupBy(F.col("mark").alias("node")).agg(F.min("text_hash").alias("text_hash"))
    wanted = one.join(nodes, "node", "left_semi")
    found = texts.select("text_hash", "text").mapInArrow(_first_texts, "text_hash bigint, text string").join(wanted, "text_hash")
    found = found.select("text", "node").mapInArrow(_sets, "node bigint, n int, grams binary")
    return written(found.dropDuplicates(["node"]), "min-max-sets")


def _with_component(bands: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return bands.withColumn("component", F.col("node"))
    return bands.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")


def open_buckets(bands: DataFrame, roots: DataFrame | None, order: int) -> DataFrame:
    """Rows of the buckets that hold more than one component, with the bucket's leader."""
    placed = _with_component(bands, roots)
    found = placed.groupBy("bucket").agg(
        F.min(F.struct(F.xxhash64("node", F.lit(order)).alias("order"), F.col("node"), F.col("component"))).alias("leader"),
        F.min("component").alias("low"), F.max("component").alias("high"))
    found = written(found.where("low <> high").select(
        "bucket", F.col("leader.node").alias("leader"), F.col("leader.component").alias("leader_component")), "min-max-buckets")
    return written(placed.join(found, "bucket"), "min-max-open")  # no bucket holds more than its band's share of all rows


def led_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) for the sets that link with a leader of several of their buckets."""
    edges = rows.where("component <> leader_component").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("shared"))
    edges = written(edges.where(F.col("shared") >= LED_BUCKETS).select("node", "leader"), "min-max-led")
    led = edges.groupBy("leader").agg(F.count(F.lit(1)).alias("led"))
    salts = written(led.select("leader", "led", F.ceil(F.col("led") / BIN_SETS).cast("int").alias("salts")), "min-max-leaders")
    total = salts.agg(F.sum("led")).first()[0] or 0
    bins = max(1, -(-2 * total // BIN_SETS))
    place = F.pmod(F.xxhash64("leader", "salt"), F.lit(bins)).alias("bin")
    members = attach(edges, salts, "leader", "led").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    members = members.join(sets, "node").select(place, "leader", F.col("node"), "n", "grams")
    leaders = salts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    leaders = leaders.join(sets.withColumnRenamed("node", "leader"), "leader").select(place, "leader", F.col("leader").alias("node"), "n", "grams")
    return members.unionByName(leaders).groupBy("bin").applyInPandas(_links_with_leaders, "a bigint, b bigint")


def _links_with_leaders(rows: pd.DataFrame) -> pd.DataFrame:
    a, b = [], []
    for leader, group in rows.groupby("leader", sort=False):
        own = np.frombuffer(group["grams"][group["node"] == leader].iloc[0], np.uint64)
        for node, grams in zip(group["node"], group["grams"], strict=True):
            other = np.frombuffer(grams, np.uint64)
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            if node != leader and (LINK_OF + LINK) * int((own[at] == other).sum()) >= LINK * (len(own) + len(other)):
                a.append(node)
                b.append(leader)
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def blocked_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) for a forest of the links between the sets of the given buckets."""
    tied = connected(rows.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    counts = tied.groupBy("root").agg(F.count(F.lit(1)).alias("sets"))
    counts = written(counts, "min-max-clusters")
    tied = written(attach(tied, counts, "root", "sets"), "min-max-tied").join(sets.select("node", "n"), "node")
    whole = tied.where(F.col("sets") <= WHOLE_CLUSTER).select("node", F.col("root").alias("cluster"), "n")
    large = tied.where(F.col("sets") > WHOLE_CLUSTER).select("node", "n")
    by_bucket = rows.select("node", F.col("bucket").alias("cluster")).join(large, "node").select("node", "cluster", "n")
    cells = _blocks(written(whole.unionByName(by_bucket), "min-max-placed"))
    return cells.join(sets, "node").select("cell", "node", "grams").groupBy("cell").applyInPandas(_links_of_cell, "a bigint, b bigint")


def links(texts: DataFrame, measured: DataFrame) -> DataFrame:
    """(node, root) of every set that links with another."""
    every = measured.where("buckets IS NOT NULL").groupBy(F.col("mark").alias("node")).agg(F.first("buckets").alias("buckets"))
    bands = written(every.select("node", F.explode("buckets").alias("bucket")), "min-max-bands")
    roots, sets, edges = None, None, []
    for turn in range(LEADER_ROUNDS + 1):
        rows = open_buckets(bands, roots, turn)
        if sets is None:
            sets = sets_of(texts, measured, rows.select("node").distinct())
        bands = rows.select("node", "bucket")
        new = led_links(rows, sets) if turn < LEADER_ROUNDS else blocked_links(rows, sets)
        edges.append(written(new, "min-max-links"))
        every_link = edges[0]
        for e in edges[1:]:
            every_link = every_link.unionByName(e)
        roots = connected(every_link)
    return roots


def near_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``, and row if ``row`` names a column of row numbers.

    A component is what links reach: 100 * overlap >= 80 * union of the sets of 2-word shingles. component_id is its
    least doc_id; ``kept`` marks one row of it, that of the least doc_id (of rows that share it, any
    one). Defined cases: a null text is empty; a text without words has no set, links with nothing and is kept;
    one of a single word has it as its only shingle; equal sets link; a null doc_id comes after
    every other, and component_id is null only where a component has no other; repeated rows link
    like others; an empty table gives no rows; other columns are left out.
    """
    texts = docs.select(
        row_of(docs, row), docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    schema = "row bigint, doc_id bigint, text_hash bigint, n_shingles bigint, mark bigint, buckets array<bigint>"
    measured = written(texts.mapInArrow(_measure, schema), "min-max-measured")
    rows = measured.select("row", "doc_id", "n_shingles", "mark")

    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = rows.where("n_shingles > 0").groupBy(F.col("mark").alias("node")).agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.join(links(texts, measured), "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = written(nodes, "min-max-nodes")
    components = nodes.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("sets"))
    nodes = attach(nodes, written(components, "min-max-components"), "root", "sets").select(
        F.col("node").alias("mark"), "copies", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keep_row"))
    found = attach(rows.where("n_shingles > 0"), written(nodes, "min-max-decided"), "mark", "copies").select(
        "row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("keep_row")).alias("kept"))
    alone = rows.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    out = found.unionByName(alone)
    return out if row else out.drop("row")


def op11_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document by 2-word shingles."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
)
SELECT r.doc_id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, r.doc_id = min(r.c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
