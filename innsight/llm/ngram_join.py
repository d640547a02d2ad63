"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence (operator 3).

Documents with equal n-gram sets are one row of the incidence matrix. The product of the matrix with its
transpose holds the overlap of every two rows; it is only computed in the blocks where an overlap can
reach the size-derived bound:

1. Rows of overlap enough share one of their first n-grams in any fixed order: of a row of size n, the first
   n - ceil(0.8 n) + 1. Frequent n-grams are put last, by a count sketch of the whole corpus.
2. The first block of columns is these n-grams. A column of few rows is multiplied entry by entry: each two of its
   rows with sizes that can link are a pair, and a pair's entries are added up.
3. Rows that share a column of many rows, with sizes that can link, are in one cluster, a block on the diagonal. Within a
   cluster (a large one cut in blocks of rows by size and hash) overlaps are accumulated over all these columns.
   Pairs that their other n-grams can't bring to the bound of their sizes are discarded in both.
4. The second block is all columns: what is still tied makes small clusters, and only their sets are brought together whole; overlaps
   are accumulated, pairs below the bound discarded, and of the links a spanning forest is kept.

Blocks have bounded size; a link is never dropped, only implied by others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from innsight.llm.common import by_content, documents, kept_rows, row_of, slices, text_or_empty, written
from innsight.llm.components import attach, connected
from innsight.llm.word_hashes import Words, words

NGRAM = 5
#: Two rows link when LINK_OF * overlap >= LINK * union.
LINK, LINK_OF = 80, 100
#: Counters of the sketch that orders n-grams; it only decides how long posting lists are, not what links.
SLOT_BITS, PART_BITS = 20, 16
#: Most rows of a block.
BLOCK_ROWS = 1500
#: Columns with more rows than this are multiplied as a dense block.
DENSE_ROWS = 48
#: First n-grams that more sets than this have among their first are multiplied by clusters, not by pairs: a posting is in fewer pairs than this.
PAIR_SETS = 64
#: A null id comes after every other.
_NULL_ID = (1 << 63) - 1


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, distinct n-gram hashes, set signature) of each text that has a word."""
    table: Words = words(texts, lower=True)
    for row in range(len(texts)):
        first, n = table.first[row], table.first[row + 1] - table.first[row]
        if n:
            grams = np.unique(table.runs(np.arange(first, first + max(1, n - NGRAM + 1)), min(n, NGRAM)))
            # a sum doesn't depend on order; the n-grams are hashes already
            yield row, grams, int(grams.sum(dtype=np.uint64).view(np.int64))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and signature of each document; at the end of a task its part of the sketch."""
    sketch = np.zeros(1 << SLOT_BITS, np.int64)
    seen: set[int] = set()
    for batch in chain.from_iterable(slices(b, "text") for b in batches):
        sizes, marks = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for row, grams, mark in shingle_sets(batch.column("text")):
            sizes[row], marks[row] = len(grams), mark
            if mark not in seen:  # copies in a task count once, so that a copied text doesn't look frequent
                np.add.at(sketch, _slot(grams), 1)
                if len(seen) < 1 << 16:
                    seen.add(mark)
        known = [batch.column(c) for c in ("row", "doc_id", "text_hash")]
        yield pa.RecordBatch.from_arrays([*known, pa.array(sizes), pa.array(marks), pa.nulls(len(sizes), pa.binary())], _MEASURED)
    parts = sketch.reshape(-1, 1 << PART_BITS)
    none = pa.nulls(len(parts), pa.int64())
    counts = pa.array([p.astype(np.int32).tobytes() for p in parts], pa.binary())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(np.arange(len(parts))), counts], _MEASURED)


_MEASURED = ["row", "doc_id", "text_hash", "n_shingles", "mark", "counts"]


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _added(part: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << PART_BITS, np.int64)
    for counts in part["counts"]:
        total += np.frombuffer(counts, np.int32)
    return pd.DataFrame({"mark": part["mark"][:1], "counts": [np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()]})


def frequency_sketch(measured: DataFrame) -> np.ndarray:
    """The sketch of the whole corpus: 2^SLOT_BITS counters, whatever the input."""
    # added up in two steps, so that no task gets more than a share of the parts
    parts = measured.where("counts IS NOT NULL").select("mark", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))
    half = parts.groupBy("mark", "salt").applyInPandas(_added, "mark bigint, counts binary")
    rows = half.groupBy("mark").applyInPandas(_added, "mark bigint, counts binary").collect()
    sketch = np.zeros((1 << (SLOT_BITS - PART_BITS), 1 << PART_BITS), np.int64)
    for r in rows:
        sketch[r["mark"]] = np.frombuffer(r["counts"], np.int32)
    return sketch.ravel()


def prefix(grams: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The n-grams of a set of which every linked set has one among its own: the rarest n - ceil(0.8 n) + 1."""
    return grams[np.lexsort((grams, sketch[_slot(grams)]))[:prefix_size(len(grams))]]


def _postings(texts: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(token, node, n) for the first n-grams of every set."""
    sent = texts.sparkSession.sparkContext.broadcast(sketch)  # 2^SLOT_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            tokens, nodes, sizes, seen = [], [], [], set()
            for _, grams, mark in shingle_sets(batch.column("text")):
                if mark not in seen:
                    seen.add(mark)
                    first = prefix(grams, sent.value)
                    tokens.append(first)
                    nodes.append(np.full(len(first), mark))
                    sizes.append(np.full(len(first), len(grams), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))],
                    ["token", "node", "n"])

    return texts.select("text").mapInArrow(run, "token bigint, node bigint, n int")


def can_link(small: Column, large: Column) -> Column:
    return small * LINK_OF >= large * LINK


def shared_postings(postings: DataFrame) -> DataFrame:
    """Distinct postings of the n-grams that more than one set has among its first, and how many sets have each (``sets``)."""
    at = Window.partitionBy("token")
    shared = postings.withColumn("shared", F.min("node").over(at) != F.max("node").over(at)).where("shared")
    shared = shared.select("token", "node", "n").distinct().withColumn("sets", F.count(F.lit(1)).over(at))
    return written(shared, "shingle-postings")


def close_sets(shared: DataFrame) -> DataFrame:
    """(node, root) of the sets that are still tied when overlaps in the first n-grams are known."""
    frequent = shared.where(F.col("sets") > PAIR_SETS)
    pairs = close_pairs(shared.where(F.col("sets") <= PAIR_SETS), frequent)
    return connected(pairs.unionByName(close_in_clusters(shared, clusters(frequent))))


def close_pairs(rare: DataFrame, frequent: DataFrame) -> DataFrame:
    """(a, b) of the sets that share a first n-gram of ``rare`` and that all others could still bring to their bound.

    Of their n-grams in ``frequent`` two sets share at most as many as the one with fewer has.
    """
    a, b = (rare.select("token", F.col("node").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, "token").where(ordered & can_link(F.col("n_a"), F.col("n_b")))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    more = frequent.groupBy("node").agg(F.count(F.lit(1)).alias("more"))
    for x in "ab":
        pairs = pairs.join(more.select(F.col("node").alias(x), F.col("more").alias(f"more_{x}")), x, "left")
    shared = F.col("shared") + F.least(*[F.coalesce(f"more_{x}", F.lit(0)) for x in "ab"])
    # all n-grams that two sets share up to where the first prefix ends are counted; past it, that set has so many more
    rest = F.greatest(*[F.col(f"n_{x}") - _prefix_size(F.col(f"n_{x}")) for x in "ab"])
    most = shared + rest
    return pairs.where(most * (LINK_OF + LINK) >= (F.col("n_a") + F.col("n_b")) * LINK).select("a", "b")


def clusters(shared: DataFrame) -> DataFrame:
    """(node, root) of the sets that share an n-gram of ``shared`` with a set of a size that can link."""
    # along a list in order of size, a gap that can't link starts a new run; a run's members are tied to its first
    by_size = Window.partitionBy("token").orderBy("n", "node")
    before = F.lag("n").over(by_size)
    gap = F.when(before.isNull() | ~can_link(before, F.col("n")), 1).otherwise(0)
    runs = shared.withColumn("gap", gap).withColumn("run", F.sum("gap").over(by_size))
    head = F.first("node").over(Window.partitionBy("token", "run").orderBy("n", "node"))
    return connected(runs.select(F.col("node").alias("a"), head.alias("b")))


def close_in_clusters(shared: DataFrame, grouped: DataFrame) -> DataFrame:
    """(a, b) for a forest over the sets of each of the clusters (node, root) that are still tied when overlaps in the first n-grams are known."""
    sizes = shared.groupBy("node").agg(F.first("n").alias("n"))
    placed = written(grouped.join(sizes, "node").select("node", F.col("root").alias("cluster"), "n"), "shingle-clusters")
    rows = shared.select("token", "node", "n").join(_blocks(placed), "node")
    return rows.groupBy("cell").applyInPandas(_close_in_cell, "a bigint, b bigint")


def prefix_size(n):
    """How many of a set's n-grams are its first: all but as many as a linked set may lack, and one."""
    return n + (-LINK * n // LINK_OF) + 1


def _prefix_size(n: Column) -> Column:
    return n - F.ceil(n * LINK / F.lit(float(LINK_OF))).cast("bigint") + 1


def _close_in_cell(cell: pd.DataFrame) -> pd.DataFrame:
    """(a, b) for a forest over the pairs of a cell that the other n-grams could still bring to their bound."""
    cell = cell.drop_duplicates(["node", "token"]).sort_values("node", kind="stable")
    nodes, first = np.unique(cell["node"].to_numpy(), return_index=True)
    size = cell["n"].to_numpy(np.int64)[first]
    shared = overlaps(np.split(cell["token"].to_numpy(np.int64), first[1:]))
    # all n-grams that two sets share up to where the first prefix ends are counted; past it, that set has so many more
    rest = size - prefix_size(size)
    most = shared + np.maximum(rest[:, None], rest[None, :])
    return _forest(nodes, (shared > 0) & _reaches(most, size))


def _reaches(overlap: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (LINK_OF + LINK) * overlap >= LINK * (size[:, None] + size[None, :])


def _blocks(placed: DataFrame) -> DataFrame:
    """Where rows go, (node, cell): one cell for clusters that fit in a block together, and for parts of large ones.

    A large cluster is cut in bands of sizes, each reaching from a size to what it can link with at most, and a band by hash
    in parts of at most about BLOCK_ROWS / 2 rows. Two parts of one band or of neighbouring bands make a cell.
    """
    counts = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))
    counts = written(counts, "cluster-sizes")
    total = counts.where(F.col("rows") <= BLOCK_ROWS).agg(F.sum("rows")).first()[0] or 0
    cells = max(1, -(-total * 4 // BLOCK_ROWS))  # a quarter full on average
    small = placed.join(counts.where(F.col("rows") <= BLOCK_ROWS), "cluster").select(
        "node", F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(cells)).cast("string")).alias("cell"))

    big = placed.join(counts.where(F.col("rows") > BLOCK_ROWS), "cluster")
    band = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(LINK_OF / LINK))).cast("int")
    big = big.withColumn("band", band)
    parts = big.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) * 2 / BLOCK_ROWS).cast("int").alias("parts"))
    parts = written(parts, "cluster-bands")
    big = big.join(parts, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # each row goes to the cells of its part with every part of its band and of the next and the previous one
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step")
    sent = big.select("node", "cluster", "band", "part", near).withColumn("other", F.col("band") + F.col("step"))
    others = parts.select("cluster", F.col("band").alias("other"), F.col("parts").alias("n_other"))
    sent = sent.join(others, ["cluster", "other"]).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)))
    mine, its = F.struct("band", "part"), F.struct(F.col("other").alias("band"), F.col("mate").alias("part"))
    name = F.concat_ws(":", "cluster", F.least(mine, its)["band"], F.least(mine, its)["part"], F.greatest(mine, its)["band"], F.greatest(mine, its)["part"])
    return small.unionByName(sent.select("node", name.alias("cell")))


def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each wanted document's set, once for each cell it goes to."""
    for batch in chain.from_iterable(slices(b, "text") for b in batches):
        nodes, cells = batch.column("node").to_pylist(), batch.column("cells").to_pylist()
        found = [(cell, mark, grams.tobytes()) for row, grams, mark in shingle_sets(batch.column("text")) if mark == nodes[row] for cell in cells[row]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["cell", "node", "grams"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of the sets' incidence matrix with its transpose, accumulated in blocks of columns."""
    m = len(sets)
    grams = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.lexsort((row, grams))
    grams, row = grams[order], row[order]
    starts = np.r_[0, np.flatnonzero(grams[1:] != grams[:-1]) + 1]
    counts = np.diff(np.r_[starts, len(grams)])
    out = np.zeros(m * m)
    for k in range(2, DENSE_ROWS + 1):  # columns of k rows: all their pairs at once
        at = starts[counts == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, (1 << 20) // len(i))
        for s in range(0, len(at), step):
            rows = row[at[s:s + step, None] + np.arange(k)]
            out += np.bincount((rows[:, i] * m + rows[:, j]).ravel(), minlength=m * m)
    out = out.reshape(m, m)
    dense = np.flatnonzero(counts > DENSE_ROWS)
    for s in range(0, len(dense), 1024):
        block = np.zeros((m, min(1024, len(dense) - s)), np.float32)
        for c, g in enumerate(dense[s:s + 1024]):
            block[row[starts[g]:starts[g] + counts[g]], c] = 1
        out += np.triu(block @ block.T, 1)  # counts up to 2^24 are exact
    return out


def _links_of_cell(cell: pd.DataFrame) -> pd.DataFrame:
    """(a, b) for a spanning forest of the links within a cell."""
    cell = cell.drop_duplicates("node")
    nodes = cell["node"].to_numpy()
    sets = [np.frombuffer(g, np.uint64) for g in cell["grams"]]
    size = np.array([len(s) for s in sets])
    return _forest(nodes, _reaches(overlaps(sets), size))


def _forest(nodes: np.ndarray, linked: np.ndarray) -> pd.DataFrame:
    """(a, b) for a spanning forest of the upper triangle of ``linked``."""
    linked = np.triu(linked, 1)
    linked |= linked.T
    root = np.full(len(nodes), -1)
    for i in range(len(nodes)):
        if root[i] < 0 and linked[i].any():
            reached, frontier = np.zeros(len(nodes), bool), np.array([i])
            reached[i] = True
            while len(frontier):
                new = linked[frontier].any(0) & ~reached
                reached |= new
                frontier = np.flatnonzero(new)
            root[reached] = i
    tied = np.flatnonzero((root >= 0) & (root != np.arange(len(nodes))))
    return pd.DataFrame({"a": nodes[tied], "b": nodes[root[tied]]})


def links(texts: DataFrame, measured: DataFrame) -> DataFrame:
    """(a, b): a forest that spans every component of linked sets with two sets or more."""
    shared = shared_postings(_postings(texts, frequency_sketch(measured)))
    grouped = close_sets(shared).withColumnRenamed("root", "cluster")
    one_of = measured.where("n_shingles > 0").groupBy(F.col("mark").alias("node")).agg(
        F.min(F.struct("text_hash", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("key"))).alias("one"), F.first("n_shingles").alias("n"))
    placed = written(grouped.join(one_of, "node").select("node", "cluster", "n", "one.text_hash", "one.key"), "shingle-placed")
    cells = _blocks(placed).groupBy("node").agg(F.collect_set("cell").alias("cells"))
    wanted = placed.select("node", "text_hash", "key").join(cells, "node").hint("merge")
    sets = texts.select("text", "text_hash", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("key")).join(wanted, ["text_hash", "key"])
    sets = sets.select("text", "node", "cells").mapInArrow(_wanted_sets, "cell string, node bigint, grams binary")
    return sets.groupBy("cell").applyInPandas(_links_of_cell, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``, and row if ``row`` names a column of row numbers.

    A component is what links reach: 100 * overlap >= 80 * union of the sets of 5-word shingles. component_id is its
    least doc_id; ``kept`` marks one row of it, that of the least doc_id (of rows that share it, any
    one). Defined cases: a null text is empty; a text without words has no set, links with nothing and is kept;
    one of fewer than five words has its whole sequence as its only shingle; equal sets link; a null doc_id comes after
    every other, and component_id is null only where a component has no other; repeated rows link
    like others; an empty table gives no rows; other columns are left out.
    """
    texts = docs.select(
        row_of(docs, row),
        docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    measured = texts.mapInArrow(_measure, "row bigint, doc_id bigint, text_hash bigint, n_shingles bigint, mark bigint, counts binary")
    measured = written(measured, "shingle-sets")
    rows = measured.where("counts IS NULL").select("row", "doc_id", "n_shingles", "mark")

    roots = connected(links(texts, measured))
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = rows.where("n_shingles > 0").groupBy("mark").agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.join(roots.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    nodes = written(nodes, "shingle-nodes")
    components = nodes.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("sets"))
    components = written(components, "shingle-components")
    nodes = attach(nodes, components, "root", "sets").select(
        "mark", "copies", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keep_row"))
    found = attach(rows.where("n_shingles > 0"), written(nodes, "shingle-decided"), "mark", "copies").select(
        "row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("keep_row")).alias("kept"))
    alone = rows.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    out = found.unionByName(alone)
    return out if row else out.drop("row")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component.

    Defined cases as in ``near_duplicates``; all columns stay, whatever their names, and of rows equal in all of them one stays.
    """
    rows = by_content(docs)
    own = rows.select("row", "document.doc_id", "document.text")
    return kept_rows(rows, near_duplicates(own, "row"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(documents(spark, sf_dir)).drop("kept")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
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
SELECT r.doc_id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
