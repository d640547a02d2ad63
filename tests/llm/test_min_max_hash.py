"""Near duplicates by min-max hashing: against all pairs, on odd rows and around hot buckets."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from innsight.llm import min_max_hash
from tests.llm.test_set_operators import ordered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(" ".join(w[k:k + 2]) for k in range(max(1, len(w) - 1))) if w else frozenset()


def all_pairs(rows):
    """(doc_id, n_shingles, component) by position; rows are (doc_id, text)."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            root[find(b)] = find(a)
    least = collections.defaultdict(lambda: None)
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            c = find(k)
            least[c] = doc_id if least[c] is None else min(least[c], doc_id)
    return [(doc_id, len(sets[k]), least[find(k)]) for k, (doc_id, _) in enumerate(rows)]


def compared(rows, got):
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == ordered(all_pairs(rows))


def families(seed=3):
    """Families around one text each: some near, some at just under and over the bound, some chains of links."""
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(12):
        base = [f"w{g}x{k}" for k in range(rng.choice([6, 21, 60, 110]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(2, len(base) // 14))):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
            rows.append((n, " ".join(w)))
            n += 1
        w = list(base)
        for k in range(30):  # a chain whose ends don't link
            w[k % len(w)] = f"step{g}y{k}"
            rows.append((n, " ".join(w)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_two_values_of_a_permutation_meet_as_often_as_sets_are_alike():
    rng = np.random.default_rng(4)
    met = []
    for _ in range(2000):
        union = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 60, dtype=np.uint64)
        a, b = min_max_hash.min_max(np.unique(union[:54])), min_max_hash.min_max(np.unique(union[6:]))
        met.append((a == b).mean())
    assert abs(np.mean(met) - 48 / 60) < 0.003
    assert np.std(met) < 1.03 * np.sqrt(0.8 * 0.2 / (2 * min_max_hash.PERMUTATIONS))  # of as many unrelated values


def test_signature_does_not_depend_on_chunks(monkeypatch):
    grams = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    whole = min_max_hash.min_max(grams)
    monkeypatch.setattr(min_max_hash, "CHUNK", 7)
    assert (min_max_hash.min_max(grams) == whole).all()


@pytest.mark.parametrize("led,whole,bin_sets", [(4, 24_000, 500), (1, 10, 8)])
def test_components_equal_all_pairs(spark, monkeypatch, led, whole, bin_sets):
    monkeypatch.setattr(min_max_hash, "LED_BUCKETS", led)
    monkeypatch.setattr(min_max_hash, "WHOLE_CLUSTER", whole)
    monkeypatch.setattr(min_max_hash, "BIN_SETS", bin_sets)
    rows = families()
    got = min_max_hash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    compared(rows, got)
    assert {r.component_id for r in got} == {r.doc_id for r in got if r.kept}


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = min_max_hash.near_duplicates(odd).collect()
    compared(rows, got)
    assert sum(r.kept for r in got if r.doc_id == 9) == 1  # repeated rows: one stays
    assert min_max_hash.near_duplicates(none).count() == 0
    with_rows = min_max_hash.near_duplicates(odd.selectExpr("doc_id", "text", "n_chars AS `a.b`", "monotonically_increasing_id() AS r"), "r")
    assert with_rows.select("row").distinct().count() == len(rows)


def test_a_table_without_links(spark):
    docs = spark.createDataFrame([(k, f"only{k} of its{k} kind{k}") for k in range(50)] + [(51, None)], "doc_id bigint, text string")
    assert all(r.component_id == r.doc_id and r.kept for r in min_max_hash.near_duplicates(docs).collect())
