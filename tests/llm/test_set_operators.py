"""Operators over the whole corpus: dedup, joins, search and mixing, against plain versions and on odd rows."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.llm import exact_dedup, mixing, ngram_join, substring_dedup, vantage_point
from innsight.llm.components import connected
from innsight.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_components(rows):
    """(n_shingles, component) by position; rows are (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append(frozenset(" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
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


def plain_removal(rows):
    """{doc_id: (n_words, n_removed, kept)} for rows with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - 19):
            window = tuple(w[i:i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        out[doc_id] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def near_copies():
    """Groups of near copies around a text, with one, two and three changed words, and texts that share a passage."""
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for g in range(6):
        base = [f"w{g}x{k}" for k in range(70)]
        for _ in range(25):
            w = list(base)
            for at in rng.integers(0, 70, rng.integers(0, 4)):
                w[at] = f"new{rng.integers(0, 5)}"
            rows.append((n, " ".join(w)))
            n += 1
    passage = [f"shared{k}" for k in range(60)]
    for g in range(40):
        rows.append((n, " ".join([*(f"own{g}y{k}" for k in range(int(rng.integers(10, 80)))), *passage])))
        n += 1
    return rows


@pytest.mark.parametrize("block_rows", [1500, 24])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(ngram_join, "DENSE_ROWS", 10)
    rows = near_copies()
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == ordered(plain_components(rows))
    assert {r.component_id for r in got} == {r.doc_id for r in got if r.kept}


def test_overlaps_equal_set_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120))).astype(np.uint64) for _ in range(90)]
    got = ngram_join.overlaps(sets)
    for i, j in itertools.combinations(range(90), 2):
        assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = ngram_join.near_duplicates(odd).collect()
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == ordered(plain_components(rows))
    kept = ngram_join.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert sum(r.kept for r in got if r.doc_id == 9) == 1  # repeated rows: one stays
    assert ngram_join.near_duplicates(none).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k + 1, k) for k in range(200)] + [(1000, k) for k in range(1001, 1050)] + [(5000, 5000)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[k] == 1000 for k in range(1000, 1050)) and 5000 not in got


def test_substring_dedup_equals_the_definition(spark):
    rng = np.random.default_rng(2)
    passages = [[f"p{g}w{k}" for k in range(rng.integers(15, 70))] for g in range(6)]
    rows = []
    for n in range(80):
        w = []
        for _ in range(rng.integers(1, 5)):
            w += [f"d{n}x{k}" for k in range(rng.integers(0, 15))]
            p = passages[rng.integers(0, 6)]
            cut = rng.integers(0, 12)
            w += p[cut:] if rng.random() < 0.5 else p
        rows.append((int(n * 7 % 80), " ".join(w)))
    rows += [(200, " ".join(["same"] * 90)), (201, None), (202, ""), (None, rows[3][1])]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == plain_removal(rows)


def test_substring_dedup_of_odd_rows(odd, none):
    got = substring_dedup.remove_repeats(odd).collect()
    want = plain_removal([(r.doc_id, r.text) for r in odd.select("doc_id", "text").distinct().collect() if r.doc_id])
    assert len(got) == odd.count()
    assert all((r.n_words, r.n_removed, r.kept) == want[r.doc_id] for r in got if r.doc_id)
    assert substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_substring_dedup_of_repeated_and_null_ids(spark, parts):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcde")
    rows = [
        (1, a), (1, a), (1, a),  # a repeated row stays
        (2, f"{b} end"), (2, f"{c} end"),  # one id, two texts: each its own spans
        (3, f"x {b}"), (3, f"{c} {c}"),
        (None, d), (None, d), (None, f"y {a} z"), (None, e), (None, f"clean {e[:60]}"), (None, f"{d} tail"), (None, f"late {d}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(parts, F.xxhash64("text", F.rand(1)))
    got = substring_dedup.remove_repeats(docs).collect()
    want = [
        (1, 30, 0, a), (1, 30, 0, a), (1, 30, 0, a), (2, 31, 0, f"{b} end"), (2, 31, 0, f"{c} end"), (3, 31, 30, "x"), (3, 60, 60, ""),
        (None, 30, 0, d), (None, 30, 0, d), (None, 32, 30, "y z"), (None, 30, 0, e), (None, len(f"clean {e[:60]}".split()), 0, f"clean {e[:60]}"),
        (None, 31, 0, f"{d} tail"), (None, 31, 30, "late"),
    ]
    assert ordered((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == ordered(want)


def test_exact_dedup_in_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex.open(spark, f"file://{tmp_path}/index", buckets=4)
    first = spark.createDataFrame([(5, "a b"), (3, "a\t\tb"), (7, "c"), (None, "c"), (8, None), (9, "")], "doc_id bigint, text string")
    got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(first, index).collect()}
    sha = {t: hashlib.sha256(t.encode()).hexdigest()[:4] for t in ("a b", "c", "")}
    assert got == {
        (5, sha["a b"]): (3, 2, False), (3, sha["a b"]): (3, 2, True), (7, sha["c"]): (7, 2, True),
        (None, sha["c"]): (7, 2, False), (8, sha[""]): (8, 2, True), (9, sha[""]): (8, 2, False)}
    again = exact_dedup.DigestIndex.open(spark, f"file://{tmp_path}/index", buckets=4)
    second = spark.createDataFrame([(1, "a b"), (2, "new"), (2, "new")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(second, again).collect())
    assert got == [(1, 3, 1, False), (2, 2, 2, False), (2, 2, 2, True)]
    assert again.read().count() == 4
    plan = again.unseen(again.read().limit(1), "another")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_a_repeated_batch_gives_the_same_rows(spark, tmp_path):
    index = exact_dedup.DigestIndex.open(spark, f"file://{tmp_path}/index", buckets=4)
    kind = "doc_id bigint, text string"
    decided = lambda df: sorted((r.doc_id, r.keep_id, r.kept) for r in df.collect())
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], kind)
    first = decided(exact_dedup.exact_dedup(docs, index, batch="monday"))
    assert first == [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert decided(exact_dedup.exact_dedup(docs, index, batch="monday")) == first  # the caller lost the first result
    assert index.read().count() == 2
    later = spark.createDataFrame([(0, "b"), (9, "c")], kind)
    assert decided(exact_dedup.exact_dedup(later, index, batch="tuesday")) == [(0, 3, False), (9, 9, True)]
    small = index.compacted(f"file://{tmp_path}/copy")
    assert sorted(map(tuple, small.read().collect())) == sorted(map(tuple, index.read().collect()))
    assert len(list((tmp_path / "copy").glob("*.parquet"))) <= 4
    assert decided(exact_dedup.exact_dedup(later, small, batch="wednesday")) == [(0, 3, False), (9, 9, False)]


def test_exact_dedup_of_odd_rows(spark, odd, none):
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    texts = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in odd.select("text").collect()}
    assert kept.count() == len(texts)
    assert exact_dedup.deduplicated(none).count() == 0


@pytest.mark.parametrize("factor", [1.0, 0.6])
def test_nearest_vectors(spark, monkeypatch, factor):
    monkeypatch.setattr(vantage_point, "SHARD_ROWS", 200)
    monkeypatch.setattr(vantage_point, "LEAF_ROWS", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6)) * rng.uniform(0.2, 3, (700, 1))
    x[100:160] = x[100]  # a very common vector: ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)]
    bad = [(1000, None), (1020, [0.0] * 6), (1040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1060, [float("nan")] * 6), (None, [1.0] * 6), (1080, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in vantage_point.nearest(vectors, vectors.where("vec_id % 20 = 0"), factor=factor).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        scores = np.array([float((x[q] * x[i]).sum()) for i in range(700)])
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-round(scores[i], 12), i))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in found)
        hits += len(set(best) & {i for _, i, _ in found})
        if factor == 1.0:
            assert [i for _, i, _ in found] == best
    assert hits >= 0.9 * 20 * len(got)


def test_nearest_of_very_large_and_small_components(spark, monkeypatch):
    monkeypatch.setattr(vantage_point, "SHARD_ROWS", 100)
    monkeypatch.setattr(vantage_point, "LEAF_ROWS", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5))
    x[7] *= 1e153
    x[20], x[33] = x[20] * 1e-120, x[33] * 1e140
    x[40] *= 1e155  # as a query its products stay finite but for those with 7 and 33
    vectors = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in vantage_point.nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 300, 20):
        scores = [float(np.einsum("d,d->", x[q], x[i])) for i in range(300)]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:20]
        assert [i for i, _ in got[q]] == best
        assert all(s == scores[i] or abs(s - scores[i]) <= 1e-12 * abs(scores[i]) for i, s in got[q])


def test_repeated_queries_of_different_vectors(spark):
    rows = [(0, [2.0, 0.0]), (0, [0.0, 3.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = vantage_point.nearest(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(2, 3.0), (1, 0.0)]


def test_nearest_of_empty_and_few_vectors(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert vantage_point.nearest(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], kind)
    assert [(r.query_id, r.vec_id) for r in vantage_point.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1), (0, 1)]


def test_mix_of_sources(spark, odd, none):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    total = sum(1 + i % 7 for i in range(390))
    copies = mixing.mix(docs)
    by_source = {r.source: (r.words, r.target) for r in copies.groupBy("source").agg(F.sum("size").alias("words"), F.first("target").alias("target")).collect()}
    assert all(abs(words - target) <= 3 * 7 for words, target in by_source.values())
    assert total - 3 * 7 <= sum(w for w, _ in by_source.values()) <= total
    assert copies.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    sequence = [r.source for r in copies.orderBy("place").collect()]
    assert len(set(sequence[:30])) == 3  # sources interleave
    again = mixing.mix(docs.repartition(2))
    assert sorted(copies.select("doc_id", "epoch").collect()) == sorted(again.select("doc_id", "epoch").collect())
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(odd).where("size = 0").count() == 0
    assert mixing.mix(none).count() == 0


def test_targets_fill_up_to_three_times_the_size(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 4}
    got = {r.source: r.target for r in mixing.water_level(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    weights = {"a": 1, "b": 2, "c": 3, None: 1}
    capped, want = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        want = {s: 3.0 * sizes[s] if s in capped else rest * weights[s] / sum(weights[t] for t in sizes if t not in capped) for s in sizes}
        more = {s for s in sizes if want[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    assert all(abs(got[s] - want[s]) < 1e-9 for s in sizes)


@pytest.mark.parametrize("name", ["op3_ngram_jaccard", "op9_substring_dedup"])
def test_queries_against_plain_versions(spark, small, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES[name](spark, small).collect()
    if name == "op3_ngram_jaccard":
        assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == ordered(plain_components(rows))
    else:
        want = plain_removal(rows)
        assert all((r.n_words, r.n_removed) == want[r.doc_id][:2] and r.kept_sha256 == hashlib.sha256(want[r.doc_id][2].encode()).hexdigest() for r in got)
