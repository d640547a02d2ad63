"""Substring dedup over a compacted de Bruijn graph of word windows (operator 9).

A window of ``WINDOW`` words is an edge from its first words to its last. Only repeated edges matter, and
the graph is cut so that they meet without moving every edge: each window belongs to the
``K``-word run with the least hash within it, its anchor, and neighbouring windows with the same anchor travel
as one path with the hash of all its words. Paths are joined on the anchor:

* an anchor met once has no repeated edge;
* equal paths are repeated as a whole, a nonbranching stretch, and all but the first go;
* where the paths of an anchor differ, the graph branches, and only the first of each is opened into its windows,
  which are joined on their own hash.

Repeated paths and windows are spans in their documents; overlapping ones grow together to the long
repeated passages, and the words under them are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from innsight.llm.common import documents, row_of, slices, text_or_empty, written
from innsight.llm.word_hashes import words

WINDOW, K = 20, 8
#: A null id comes after every other.
_NULL_ID = (1 << 63) - 1
_SPANS = "array<struct<start:int,n:int>>"


def paths(first: np.ndarray, table) -> tuple[np.ndarray, ...]:
    """Anchor hash, path hash, text, first word and number of windows of every path."""
    hashes = table.hashes
    if len(hashes) < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    runs = table.runs(np.arange(len(hashes) - K + 1), K)
    anchor = np.arange(len(hashes) - WINDOW + 1) + sliding_window_view(runs, WINDOW - K + 1).argmin(1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text[:len(anchor)] == text[WINDOW - 1:]
    at = np.flatnonzero(whole)  # windows that lie in one text
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.r_[True, (np.diff(at) > 1) | (np.diff(anchor[at]) != 0) | (np.diff(text[at]) != 0)]
    start = at[new]
    n = np.diff(np.r_[np.flatnonzero(new), len(at)])
    return runs[anchor[start]].view(np.int64), table.runs(start, n + WINDOW - 1).view(np.int64), text[start], start - first[text[start]], n


def _reduced(names: list[np.ndarray], key: np.ndarray, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows that stay of a slice's groups of equal ``names``: their indices, whether each is a known repeat, and tied rows.

    A known repeat starts later than the first of its group. What starts level with the first, in other rows, has its
    fate: those row numbers travel in the first's list (null if there are none).
    """
    order = np.lexsort((row, start, key, *names[::-1]))
    new = np.ones(len(order), bool)
    for k in names:
        new[1:] &= k[order][1:] == k[order][:-1]
    new[1:] = ~new[1:]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    known = (key[order] != key[first]) | (start[order] != start[first])
    level = ~new & ~known
    ends = np.cumsum(level)[~level]  # rows level with a first come right after it
    ends = np.r_[ends[1:], level.sum()] if len(ends) else ends
    offsets = np.r_[0, ends].astype(np.int32)
    tied = pa.ListArray.from_arrays(pa.array(offsets), pa.array(row[order[level]]), mask=pa.array(np.diff(offsets) == 0))
    return order[~level], known[~level], tied


def _emit_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of a task's texts. Within a slice only the first of equal paths keeps its anchor; later ones are known repeats."""
    for batch in chain.from_iterable(slices(b, "text") for b in batches):
        table = words(batch.column("text"))
        anchor, path, text, start, n = paths(table.first, table)
        key, row = batch.column("key").to_numpy()[text], batch.column("row").to_numpy()[text]
        at, known, tied = _reduced([anchor, path], key, start, row)
        # a known repeat needs no partner: its own place spreads it
        anchor = np.where(known, row[at] * 1_000_003 + start[at], anchor[at])
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(path[at]), pa.array(key[at]), pa.array(start[at].astype(np.int32)), pa.array(n[at].astype(np.int32)), pa.array(known),
             pa.array(row[at]), tied],
            ["anchor", "path", "key", "start", "n", "known", "row", "tied"],
        )


def _every_row() -> Column:
    """The row and those tied to it, one each."""
    return F.explode(F.concat(F.array("row"), F.coalesce("tied", F.array().cast("array<bigint>")))).alias("row")


def repeated_paths(texts: DataFrame) -> DataFrame:
    """(row, start, n, whole): paths repeated as a whole, and the first of each path of a branching anchor."""
    met = texts.mapInArrow(_emit_paths, "anchor bigint, path bigint, key bigint, start int, n int, known boolean, row bigint, tied array<bigint>")
    at_anchor, of_path = Window.partitionBy("anchor"), Window.partitionBy("anchor", "path")
    here = F.struct("key", "start")
    placed = met.repartition("anchor").withColumn("branching", F.min("path").over(at_anchor) != F.max("path").over(at_anchor))
    placed = placed.withColumn("earliest", F.min(here).over(of_path))
    whole = F.col("known") | (here > F.col("earliest"))
    return placed.withColumn("whole", whole).where("whole OR branching").select(_every_row(), "start", "n", "whole")


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the opened paths: hash, key, first word; equal ones of a slice as in ``_emit_paths``."""
    for batch in chain.from_iterable(slices(b, "text") for b in batches):
        batch = batch.filter(pa.compute.is_valid(batch.column("spans")))
        table = words(batch.column("text"))
        spans = batch.column("spans")
        text = np.repeat(np.arange(len(spans)), pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False))
        flat = spans.flatten()
        start, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text, start = np.repeat(text, n), np.repeat(start, n) + step
        window = table.runs(table.first[text] + start, WINDOW).view(np.int64)
        key, row = batch.column("key").to_numpy()[text], batch.column("row").to_numpy()[text]
        at, known, tied = _reduced([window], key, start, row)
        window = np.where(known, row[at] * 1_000_003 + start[at], window[at])
        yield pa.RecordBatch.from_arrays(
            [pa.array(window), pa.array(key[at]), pa.array(start[at].astype(np.int32)), pa.array(known), pa.array(row[at]), tied],
            ["window", "key", "start", "known", "row", "tied"])


def repeated_windows(texts: DataFrame, opened: DataFrame) -> DataFrame:
    """(row, start) of the windows of opened paths that start earlier elsewhere."""
    opened = opened.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    met = texts.join(opened.hint("merge"), "row", "left").mapInArrow(
        _emit_windows, "window bigint, key bigint, start int, known boolean, row bigint, tied array<bigint>")
    here = F.struct("key", "start")
    placed = met.withColumn("earliest", F.min(here).over(Window.partitionBy("window")))
    return placed.where(F.col("known") | (here > F.col("earliest"))).select(_every_row(), "start")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chain.from_iterable(slices(b, "text") for b in batches):
        counts, removed, kept = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            tokens = text.as_py().encode().split()  # bytes split at the same six characters
            counts.append(len(tokens))
            if spans:
                covered = np.zeros(len(tokens) + 1, np.int64)
                start = np.array([s["start"] for s in spans])
                end = np.minimum(start + [s["n"] + WINDOW - 1 for s in spans], len(tokens))
                start = np.minimum(start, len(tokens))
                np.add.at(covered, start, 1)
                np.add.at(covered, end, -1)
                tokens = [t for t, c in zip(tokens, covered.cumsum()[:-1] == 0, strict=True) if c]
            removed.append(counts[-1] - len(tokens))
            kept.append(b" ".join(tokens).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by spaces) for every row of ``docs``.

    A word goes if a window over it starts earlier too, in a smaller doc_id or earlier in its
    document; windows are judged on the input. Defined cases: a null text is empty; texts of fewer than
    WINDOW words stay whole; a null doc_id comes after every other; rows with the same doc_id, or with
    none, have the same place: of windows that start at the same word of each neither starts earlier, so a repeated
    row stays, and one that starts at a later word goes; each row loses only its own spans; an empty table gives
    no rows; other columns are left out.
    """
    key = F.coalesce(docs["doc_id"].cast("bigint"), F.lit(_NULL_ID))
    # spans belong to a row, as ids may repeat; the row number holds once it is written
    texts = written(docs.select(row_of(docs, None), key.alias("key"), text_or_empty(docs).alias("text")), "texts")
    repeats = written(repeated_paths(texts), "repeated-paths")
    windows = repeated_windows(texts, repeats.where("NOT whole"))
    spans = repeats.where("whole").select("row", "start", "n").unionByName(windows.select("row", "start", F.lit(1).alias("n")))
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    out = texts.join(spans.hint("merge"), "row", "left").mapInArrow(_remove, "key bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.when(F.col("key") != _NULL_ID, F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document, as counts and a digest."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM x
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE nth > 1
), g AS (
  SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
), k AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN w
              ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END AS kept
  FROM d LEFT JOIN g ON d.doc_id = g.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
