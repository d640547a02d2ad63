"""Periodic runs of words by a dictionary of basic factors (operator 13).

The dictionary names, for each power of two, the factors of that length: equal names, equal words. Take a run of
smallest period q and the power of two from q to under 2q: as no shorter shift maps a stretch of q words or more of the
run to itself, the next place of the factor that starts anywhere in the run is exactly q words on. So places whose successor is within
the factor's own length, one after the other with one distance, are an arithmetic progression for every phase of the
period at once; they propose the period, are extended word by word to the whole run, and what two lengths propose is kept once.

Only factors with an equal one near them are named again at the next length, so the work falls quickly where nothing repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.common import documents, slices, text_or_empty

#: A run has at least so many words, and at least so many periods.
MIN_LENGTH, MIN_REPEATS = 24, 3
_WORD = r"[^\x20\x09-\x0D]+"
_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs_of(words: np.ndarray, document: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """(start, length, period) by start, then period, of the runs of ``words``, numbers that are equal where the words are.

    ``document`` says, in ascending order, which text a word is of; no run goes over the end of a text. Needs ``min_repeats`` of three
    at least: then every run has a place whose successor tells its period.
    """
    n = len(words)
    at = np.arange(n)  # places whose factor of the current length has an equal one near
    name = words.astype(np.int64)
    proposed, size = [], 1
    while len(at):
        # successors: equal names in one text, next to each other in order of place
        order = np.lexsort((at, name, document[at]))
        place, label = at[order], name[order]
        equal = (label[1:] == label[:-1]) & (document[place[1:]] == document[place[:-1]])
        gap = np.where(equal, place[1:] - place[:-1], 0)
        near = np.flatnonzero((gap > size // 2) & (gap <= size))
        if len(near):
            start, period = place[near], gap[near]
            by_period = np.lexsort((start, period))
            start, period = start[by_period], period[by_period]
            first = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (period[1:] != period[:-1]) | (document[start[1:]] != document[start[:-1]])])
            last = np.r_[first[1:], len(start)] - 1
            length = start[last] - start[first] + size + period[first]
            long = length >= np.maximum(min_length, min_repeats * period[first])
            proposed.append(np.column_stack([start[first], length, period[first]])[long])
        # a longer factor repeats only where both its halves do
        twice = np.zeros(len(place), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        number = np.full(n, -1)
        number[place[twice]] = np.cumsum(np.r_[True, ~equal])[twice]
        at = np.flatnonzero((number[:max(0, n - size)] >= 0) & (number[size:] >= 0))
        at = at[document[at] == document[at + size]]
        name = number[at] * (n + 2) + number[at + size]
        size *= 2
    found = {_extended(words, document, *run) for run in chain.from_iterable(p.tolist() for p in proposed)}
    return np.array(sorted((start, period, length) for start, length, period in found), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _extended(words: np.ndarray, document: np.ndarray, start: int, length: int, period: int) -> tuple[int, int, int]:
    """The whole stretch around a proposed one that keeps its period; the words of a true proposal already end it."""
    def same(k: int) -> bool:
        return words[k] == words[k + period] and document[k] == document[k + period]

    end = start + length
    while start > 0 and same(start - 1):
        start -= 1
    while end < len(words) and same(end - period):
        end += 1
    return start, end - start, period


def _numbered_words(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, and of all of them their numbers and texts."""
    split = [t.split() for t in texts]  # of bytes: space and tab to carriage return, nothing else
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(split)), np.int64)
    return split, numbers, np.repeat(np.arange(len(split)), [len(w) for w in split])


def _longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run has after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), the most repeated run and the collapsed text of every row of ``docs``.

    A run is a maximal stretch of words with smallest period q, of at least ``min_length`` words and ``min_repeats`` (three or
    more) periods; start counts words from 0. The collapsed text has the words that no run has after its first period, joined by one
    space. Defined cases: a null, empty or blank text has no words, no runs, no most repeated run (null) and an empty
    collapsed text; runs may overlap; of equally repeated runs the first is the smallest start, then period; null and
    repeated ids are rows like others; an empty table gives no rows; other columns are left out.
    """
    if min_repeats < 3:
        raise ValueError("min_repeats must be three or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            words, numbers, document = _numbered_words(batch.column("text").cast(pa.binary()).to_pylist())
            first = np.r_[0, np.cumsum([len(w) for w in words])]
            found: list[list[tuple[int, int, int]]] = [[] for _ in words]
            for start, length, period in runs_of(numbers, document, min_length, min_repeats).tolist():
                found[document[start]].append((start - int(first[document[start]]), length, period))
            text = [b" ".join(collapsed_words(w, r)) for w, r in zip(words, found, strict=True)]
            as_runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
            best = [None if r is None else {"start": r[0], "length": r[1], "period": r[2]} for r in map(_longest, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(as_runs, pa.list_(_RUN_TYPE)),
                 pa.array(best, _RUN_TYPE), pa.array(text, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "longest", "collapsed"])

    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    return own.mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{_RUN}>, longest {_RUN}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or in one of ten by a hash of the id (null: empty text), its words from a place on replaced by repeats of a stretch.

    With h the crc32 of the id and g = h // 10, word i of n from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))

    def with_repeats(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        stretch = F.slice(w, a + 1, p)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(F.array_repeat(stretch, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)), " ")

    # a lambda binds the words once
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, with_repeats(w)).otherwise(F.lit(""))), 1)
    return F.when(h % 10 == 0, changed).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten of them with planted repeats."""
    docs = documents(spark, sf_dir)
    docs = docs.select("doc_id", planted(F.col("doc_id"), text_or_empty(docs)).alias("text"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.floor(F.expr("longest.length * 1000 div longest.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Twelve words at a run's start come again one period on, so pairs of equal stretches of twelve words hold every run.
OP13_SQL = r"""
WITH b AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS byte_crc
), d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda c, x: xor(c >> 8, byte_crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM documents, b
), a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM d
), p AS (
  SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM a
), t AS (
  SELECT doc_id, list_transform(range(len(w)), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) AS w FROM p
), g AS (
  SELECT doc_id, i, len(w) AS n, hash(w[i + 1:i + 12]) AS g, w[i + 1:i + 12] AS s FROM (SELECT *, unnest(range(len(w) - 11)) AS i FROM t)
), e AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND x.s = y.s AND x.i < y.i
  WHERE 3 * (y.i - x.i) <= x.n
), r AS (
  SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 12 + q AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island
  HAVING max(i) - min(i) + 12 + q >= greatest(24, 3 * q)
), u AS (
  SELECT * FROM r WHERE NOT EXISTS (
    SELECT 1 FROM r f WHERE f.doc_id = r.doc_id AND f.q < r.q AND f.s <= r.s AND f.s + f.l >= r.s + r.l)
), m AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s, l, q), (-(l / q), s, q)) AS best,
         string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         list(struct_pack(s, l, q)) AS runs
  FROM u GROUP BY doc_id
), k AS (
  SELECT t.doc_id, coalesce(array_to_string(list_filter(t.w, lambda x, j: m.runs IS NULL OR NOT list_bool_or(list_transform(m.runs,
         lambda r: j > r.s + r.q AND j <= r.s + r.l))), ' '), '') AS kept, m.*EXCLUDE doc_id
  FROM t LEFT JOIN m ON t.doc_id = m.doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period,
       best.l * 1000 // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(kept) AS collapsed_sha256
FROM k
"""
