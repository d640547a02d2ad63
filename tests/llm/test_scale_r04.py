"""Findings of round 4: the n-gram join's work when sets share n-grams by chance."""

import itertools
import random

import numpy as np
import pytest

from innsight.llm import ngram_join
from tests.llm.test_set_operators import ordered, plain_components


def texts_that_share_by_chance():
    """Texts that share one n-gram with each of twelve others: far from linking, but all in one cluster."""
    return [(i, " ".join(word for step in range(1, 7) for first in (i, (i - step) % 150)
                         for word in (*(f"run{first}x{step}x{k}" for k in range(5)), f"own{i}x{step}x{first}"))) for i in range(150)]


def test_sets_that_share_an_n_gram_by_chance_are_not_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 10)
    dealt, blocks = [], ngram_join._blocks

    def counted(placed):
        cells = blocks(placed)
        dealt.append(cells.count())
        return cells

    monkeypatch.setattr(ngram_join, "_blocks", counted)
    # a sketch so full that it tells no n-gram from another, as very many texts leave it
    monkeypatch.setattr(ngram_join, "frequency_sketch", lambda measured: np.full(1 << ngram_join.SLOT_BITS, 1000))
    rows = texts_that_share_by_chance()
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i) for i, _ in rows]
    assert sum(dealt) <= len(rows)


@pytest.mark.parametrize("pair_sets", [1, 3])
def test_pairs_and_clusters_find_the_same_links(spark, monkeypatch, pair_sets):
    monkeypatch.setattr(ngram_join, "PAIR_SETS", pair_sets)
    rng = random.Random(4)
    rows, number = [], itertools.count()
    for base in range(12):
        words = [f"b{base}w{rng.randrange(40)}" for _ in range(rng.choice([3, 12, 60]))]
        for _ in range(8):
            changed = [f"new{next(number)}" if rng.random() < 0.02 else w for w in words]
            rows.append((len(rows), " ".join(changed[:len(changed) - rng.randrange(4)] + ["of", "the", "and", "to", "in"])))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == ordered(plain_components(rows))
