"""Fill-in-the-middle and periodic runs: against plain versions and on odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.llm import fill_in_middle, periodic_runs
from innsight.llm.registry import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def shown(rows):
    return sorted(map(repr, rows))


def test_fill_in_middle_equals_the_plain_version_and_is_undone(spark, odd, none):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    pieces = ["ab", "C", " ", "\n", "<", "<P", ">", "S>", "<S>", "<M>", "é", "語", "😀", "1", "\x00", "P>"]
    rows += [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for k in range(100, 900)]
    rows.append((901, "<<P<S<M" * 40))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = fill_in_middle.fill_in_middle(docs.withColumn("form", F.lit("clash")).withColumn("cut", F.lit(1)))
    out = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert shown((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out) == shown(
        (i, *plain_fill(i, t), t or "") for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(none).count() == 0
    assert fill_in_middle.fill_in_middle(odd).count() == odd.count()


def test_fill_in_middle_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = []
    for r in docs:
        *head, output = plain_fill(r.doc_id, r.text)
        want.append((r.doc_id, *head, sha(output), sha(r.text or "")))
    assert shown(map(tuple, QUERIES["op12_fill_in_middle"](spark, small).collect())) == shown(want)


def plain_runs(w):
    """(start, length, period) by trying every period."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            stretch = w[s:s + length]
            if length >= max(24, 3 * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_result(doc_id, w):
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def plain_planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_equal_all_periods():
    rng = random.Random(7)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(0, 4)):
            w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 90))]
            if w and rng.random() < 0.6:  # one stretch, again and again
                a, q = rng.randrange(len(w)), rng.randint(1, 12)
                w = [w[i] if i < a else w[min(a + (i - a) % q, len(w) - 1)] for i in range(len(w))]
            texts.append(w)
        words = np.array([x for w in texts for x in w], np.int64)
        document = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        want, first = [], 0
        for w in texts:
            want += [[s + first, n, q] for s, n, q in plain_runs(w)]
            first += len(w)
        assert periodic_runs.runs_of(words, document).tolist() == want


def test_runs_of_one_long_repeated_word_and_of_nested_repeats():
    assert periodic_runs.runs_of(np.zeros(100_000, np.int64), np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]
    nested = ([0] * 30 + [1]) * 4
    assert [tuple(r) for r in periodic_runs.runs_of(np.array(nested), np.zeros(len(nested), int)).tolist()] == plain_runs(nested)


def test_periodic_runs_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows += [(200, "la " * 24), (201, "la " * 23), (202, "la " * 24), (None, "a\tb\n" * 12 + "A b"), (203, "a\xa0b " * 30)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, runs int, start string").repartition(3)
    out = periodic_runs.periodic_runs(docs).collect()
    want = []
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        long = [(k, min(240, len(w) - k), 24) for k in range(0, len(w), 240)]  # as the row of 20 000 words is made
        want.append((i, len(w), plain_runs(w) if len(w) < 10_000 else long))
    assert shown((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in out) == shown(want)
    assert {r.collapsed for r in out if r.doc_id in (200, 202)} == {"la"}
    assert all(r.longest is None for r in out if not r.runs)
    assert periodic_runs.periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, min_repeats=2)


def test_periodic_runs_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = []
    for r in docs:
        w = plain_planted(r.doc_id, [x.decode() for x in (r.text or "").encode().split()])
        if len(w) <= 1500:
            want.append(plain_result(r.doc_id, w))
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, small).collect()}
    assert len(got) == len(docs) and len(want) > 150
    assert [got[w[0]] for w in want] == want


def test_planted_repeats_of_blank_and_null_ids(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = ["", " \t", "one", "a b", " ".join(map(str, range(50))), "x  y\tz\n" * 9]
    rows = [(i, texts[k % len(texts)]) for k, i in enumerate(ids)] + [(None, "a b"), (1, " keeps  its\tspace ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("p", periodic_runs.planted(F.col("doc_id"), F.col("text")))
    for r in df.collect():
        if r.doc_id in ids:
            assert r.p == " ".join(plain_planted(r.doc_id, r.text.split()))
        elif r.doc_id == 1:
            assert r.p == r.text
