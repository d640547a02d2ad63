"""Findings of round 3: work per task, work done once, terms counted in the row."""

import math

import pytest
from pyspark.sql import functions as F

from innsight.functions import text as tx
from innsight.operators import learn
from innsight.plans import adapters
from innsight.sources import sinks


def test_tasks_of_a_scan_grow_with_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.parquet")
    spark.range(200_000).select("id", F.md5(F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(path)
    monkeypatch.setattr(adapters, "BYTES_PER_TASK", 100_000, raising=False)
    dealt = adapters.spread_scan(spark.read.parquet(path))
    assert dealt.rdd.getNumPartitions() > 60
    assert dealt.agg(F.count_distinct("id")).first()[0] == 200_000


def test_texts_without_contrast_words_are_marked_alike(spark):
    texts = ["good food , bad room", "good but bad", f"a{tx.TURN}b", "x .or. y;\n z", "though, a aur b", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r[0] for r in df.orderBy("id").select(tx.mark_clauses(F.col("text"))).collect()]
    cut, turn = tx.CUT, tx.TURN
    assert got == [f"good food{cut}bad room", f"good{turn}bad", f"a{turn}b", f"x{cut}y{cut}z", f"{turn}a{cut}b", "", None]


def test_spelling_looks_at_whole_words(spark):
    texts = ["machine  achi\tx", "nhi", "nhi, bht\U0001f44dbht", "a  b　c", "été ❤"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r[0] for r in df.orderBy("id").select(tx.normalise(F.col("text"))).collect()]
    assert got == ["machine accha x", "nahi", "nhi, bahut good bahut", "a b c", "été good"]


TEXTS = [(1, "Room room ROOM was good"), (2, "the room"), (2, "room but the"), (3, None), (None, "good good"), (None, "good"), (4, "खाना it's 5x")]


def test_terms_counted_in_rows_equal_the_native_features(spark):
    texts = spark.createDataFrame(TEXTS, "id int, text string")
    want = texts.select("id", F.explode(tx.ngram_features(F.col("text"))).alias("term")).groupBy("id", "term").count()
    got = learn.term_counts(texts)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_unshared_ids_need_no_shuffle(spark):
    texts = spark.createDataFrame([t for t in TEXTS if t[0] in (1, 3, 4)], "id int, text string")
    assert "Exchange" not in learn.term_counts(texts)._jdf.queryExecution().executedPlan().toString()


def test_row_terms_are_the_weighted_terms(spark):
    texts = spark.createDataFrame([(i, f"good room {'bad ' * (i % 4)}x{i % 3}") for i in range(30)], "id int, text string")
    vocab = learn.vocabulary(learn.term_counts(texts), 30)
    rows = learn.row_terms(texts, vocab.orderBy("idx").collect()).collect()
    want = {(r["id"], r["idx"]): r["value"] for r in learn.weighted_terms(learn.term_counts(texts), vocab).collect()}
    got = {(r["id"], i): w / r["_norm"] for r in rows for i, w in zip(r["_i"], r["_w"])}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


@pytest.mark.parametrize("items", [1, 200_000])
def test_slices_keep_every_text(spark, monkeypatch, items):
    monkeypatch.setattr(learn, "SLICE_ITEMS", items)
    texts = spark.range(50).select("id", F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    assert sorted(r["id"] for r in learn.counted_grams(texts, "id").collect()) == list(range(50))


def test_a_snapshot_computes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(100, numPartitions=2).select(F.lit("p").alias("property_id"), "id").mapInArrow(count, "property_id string, id long")
    sinks.write_snapshot({"mentions": rows}, str(tmp_path / "s"), rows_per_file=30)
    assert sinks.read_snapshot(spark, str(tmp_path / "s"), "mentions").count() == 100 and made.value == 100


def test_only_runs_that_name_an_aspect_are_tokenised(spark):
    aspects = {"Room": ["room", "hot water", "खाना"], "Staff": ["staff", "24x7"]}
    texts = ["roomy place, staffed. the room's x; Hot  Water or room_1", "room but nice, bad", "nice. but room", "24x7 or खानाx", f"a{tx.CUT}room{tx.TURN}b", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").orderBy("id")
    norm = tx.normalise(F.col("text"))
    kept = df.select(F.filter(tx._runs(norm), lambda run: tx._names_any(run, aspects))).collect()
    assert [None if r[0] is None else len(r[0]) for r in kept] == [2, 1, 1, 1, 1, 0, None]
    found = df.select(F.transform(tx.aspect_clauses(norm, aspects), lambda c: c["clause"])).collect()
    assert [r[0] for r in found] == [["hot water", "room_1"], ["room", "nice"], ["room"], ["खानाx"], ["room", "b"], [], None]


def test_marks_and_emoji_are_seen_in_any_text(spark):
    texts = ["ASCII only", "e\u0301te\u0301", "caf\u00e9", "x\U0001f44d", "\u00e9\u2764y", "\u212b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").orderBy("id")
    got = [tuple(r) for r in df.select(tx.normalise(F.col("text")), tx._beyond_latin(F.col("text"))).collect()]
    assert got == [("ascii only", False), ("\u00e9t\u00e9", True), ("caf\u00e9", False), ("x good", True), ("\u00e9 good y", True), ("\u00e5", True)]
