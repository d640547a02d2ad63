import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from innsight import config
from innsight.operators import evaluate, learn
from innsight.streaming import label_stream

TAXONOMY = list(config.ASPECTS)
GOLD = [("1", "Food;Room", "Food=1;room=-1", "mixed", "long enough text here"),
        ("2.0", "Food", "Food=-1", "", "ok"), ("3", "none", "", "sarcasm", "x"),
        ("4", "Food", "Food=0", "", "a b c d e"), ("5", "", "", "", "unlabelled")]
PRED = [("1", "Food", "Food=1"), ("2", "Food", "Food=1"), ("4", "Food", "Food=1"),
        ("9", "Staff", "Staff=1")]


@pytest.fixture(scope="module")
def scored(spark):
    gold = spark.createDataFrame(GOLD, "review_id string, gold_aspects string, "
                                 "gold_sentiment_per_aspect string, notes string, text string")
    pred = spark.createDataFrame(PRED, "review_id string, pred_aspects string, "
                                 "pred_sentiment_per_aspect string")
    return (evaluate.parse_labels(gold, "gold", TAXONOMY),
            evaluate.parse_labels(pred, "pred", TAXONOMY))


def test_hand_computed_scores(scored):
    gold, pred = scored
    evaluate.check_labels(gold)
    by = {r["aspect"]: r["f1"] for r in evaluate.aspect_scores(gold, pred).collect()}
    assert by == {"Food": 1.0, "Room": 0.0}
    assert evaluate.macro(evaluate.aspect_scores(gold, pred)).first()["f1"] == .5
    pairs = evaluate.matched_sentiments(gold, pred)
    row = evaluate.sentiment_summary(pairs).first()
    assert row["n_matched"] == 3 and abs(row["accuracy"] - 1 / 3) < 1e-12
    classes = {r["label"]: r["f1"] for r in evaluate.class_scores(pairs).collect()}
    assert abs(classes[1] - .5) < 1e-12 and classes[0] == 0 == classes[-1]
    counts = evaluate.coverage_counters(gold, pred).first()
    assert tuple(counts) == (4, 1, 1, 1)
    errors = {r["category"]: (r["reviews"], r["errors"])
              for r in evaluate.error_analysis(gold, pred).collect()}
    assert errors == {"mixed_aspects": (1, 1), "very_short": (1, 0), "sarcasm": (1, 0)}


@pytest.mark.parametrize("row", [("1", "Fod", ""), ("1", "Food", "Food=2"), ("1", "", "Food"),
                                 ("", "Food", "")])
def test_bad_labels(spark, row):
    df = spark.createDataFrame([row], "review_id string, gold_aspects string, "
                               "gold_sentiment_per_aspect string")
    with pytest.raises(ValueError):
        evaluate.check_labels(evaluate.parse_labels(df, "gold", TAXONOMY))


def test_hash_slices(spark):
    import hashlib
    df = spark.createDataFrame([(str(i),) for i in range(50)], "review_id string")
    for r in evaluate.labelling_slices(df, ["A", "P", "R"]).collect():
        want = int(hashlib.sha256(r["review_id"].encode()).hexdigest(), 16) % 3
        assert r["annotator"] == ["A", "P", "R"][want]


def test_corpus_and_splits(spark):
    rows = spark.createDataFrame(
        [(1, "Same text", 1, "test", "s", "g1"), (2, "same  TEXT", 0, "train", "s", "g2"),
         (3, "gone", 1, "train", "s", "g1"), (4, "  ", 1, "dev", "s", "g1")],
        "id int, text string, label int, split string, source string, `group` string")
    got = learn.assemble_corpus(rows, spark.createDataFrame([("GONE",)], "text string")).collect()
    assert [(r["id"], r["split"]) for r in got] == [(2, "train")]
    many = spark.range(300).select("id", (F.col("id") % 20).alias("group"), F.lit(1).alias("label"))
    per_group = learn.grouped_splits(many).groupBy("group").agg(F.count_distinct("split").alias("k"))
    assert per_group.where("k > 1").count() == 0


def test_training_learns_a_separable_rule(spark, tmp_path):
    words = {1: "good lovely", 0: "plain table", -1: "awful dirty"}
    rows = [(i, f"{words[i % 3 - 1]} stay number {i % 7}", i % 3 - 1, "dev" if i % 5 == 0 else "train",
             "s", "g") for i in range(90)]
    corpus = spark.createDataFrame(
        rows, "id int, text string, label int, split string, source string, `group` string")
    model, tuning = learn.train(corpus, c_grid=(1.0, 4.0), max_iter=20)
    assert tuning.count() == 2 and tuning.agg(F.max("macro_f1")).first()[0] == 1.0
    model.save(str(tmp_path / "model"))
    loaded = learn.TextModel.load(spark, str(tmp_path / "model"))
    texts = spark.createDataFrame([(1, "lovely place"), (2, "dirty place"), (3, "")],
                                  "id int, text string")
    got = {r["id"]: r["pred"] for r in learn.score_texts(texts, loaded).collect()}
    assert got[1] == 1 and got[2] == -1 and got[3] in (-1, 0, 1)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "A", "2024-01-01", "Food was good"), (2, "A", "2024-01-01", ""),
            (3, "B", "2024-01-02", "x" * 2001)]
    schema = StructType([StructField("review_id", IntegerType())] + [
        StructField(c, StringType()) for c in ("property_id", "date", "text")])
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    stream = label_stream.label_stream(
        label_stream.read_review_stream(spark, str(tmp_path / "in"), schema), limit=config.TEXT_LIMIT)
    label_stream.start_labelling(stream, str(tmp_path / "out"), str(tmp_path / "cp"),
                                 available_now=True).awaitTermination()
    got = {r["review_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1]["aspect"] == "Food" and got[1]["sentiment"] == 1
    assert got[2]["rejected"] == "empty text" and "longer" in got[3]["rejected"]
    whole = label_stream.label_stream(label_stream.read_review_stream(spark, str(tmp_path / "in"), schema))
    label_stream.start_labelling(whole, str(tmp_path / "out2"), str(tmp_path / "cp2"), available_now=True).awaitTermination()
    assert {r["review_id"] for r in spark.read.parquet(str(tmp_path / "out2")).where("rejected IS NOT NULL").collect()} == {2}


def _texts(spark):
    words = ["good room", "bad food", "the staff was good", "no water", "room room room", "", None, "food was bad bad", "good good view", "the view"]
    return spark.createDataFrame([(i, words[i % 10] + f" w{i % 4}" if words[i % 10] is not None else None) for i in range(60)], "id int, text string")


@pytest.mark.parametrize("slots,features", [(1 << 20, 60_000), (8, 25), (4, 40), (64, 10)])
def test_bounded_vocabulary_is_the_vocabulary(spark, slots, features):
    texts = _texts(spark)
    want = learn.vocabulary(learn.term_counts(texts), 60, 3, features).orderBy("idx").collect()
    assert learn.bounded_vocabulary(texts, 60, 3, features, slots).orderBy("idx").collect() == want


def test_scores_in_rows_equal_joined_terms(spark):
    texts = _texts(spark)
    vocab = learn.vocabulary(learn.term_counts(texts), 60).cache()
    coefs = vocab.select("idx", F.explode(F.array(F.lit(-1), F.lit(1))).alias("label")).withColumn("coef", ((F.col("idx") * 7 * F.col("label")) % 5).cast("double"))
    model = learn.TextModel(vocab, coefs, {-1: 0.2, 1: 0.2})
    scored = learn.score_texts(texts, model)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    sums = {(r["id"], r["label"]): r["s"] for r in learn.weighted_terms(learn.term_counts(texts), vocab).join(coefs, "idx").groupBy("id", "label").agg(
        F.sum(F.col("value") * F.col("coef")).alias("s")).collect()}
    for r in scored.collect():
        low, high = sums.get((r["id"], -1), 0.0), sums.get((r["id"], 1), 0.0)
        assert abs(r["margin"] - abs(low - high)) < 1e-9 and (r["pred"] == (1 if high > low + 1e-12 else -1) or abs(low - high) < 1e-9)


def test_report_levels_and_town_rule(spark):
    rows = [(i, "a" if i < 8 else "b", "x" if i % 2 else None, "big" if i < 6 else "small", (i % 3) - 1, (i % 2), 0) for i in range(12)]
    scored = spark.createDataFrame(rows, "id int, source string, state string, town string, gold int, model int, rules int")
    cells = learn.report_cells(scored, scored, ["model", "rules"], ["state", "town"], "town", min_town=5)
    keys = ["system", "source", "state", "town"]
    levels = {tuple(r) for r in cells.select(*keys).distinct().collect()}
    assert levels == {(s, *rest) for s in ("model", "rules") for rest in (
        ("*", "*", "*"), ("a", "*", "*"), ("b", "*", "*"), ("a", "x", "*"), ("b", "x", "*"), ("a", "*", "big"))}
    report = {tuple(r[:5]): r for r in learn.class_report(cells, keys).collect()}
    assert report[("rules", "*", "*", "*", 0)]["support"] == 4 and report[("rules", "*", "*", "*", 0)]["precision"] == pytest.approx(4 / 12)
    table = {tuple(r[:5]): tuple(r[5:]) for r in learn.confusion_table(cells, keys).collect()}
    assert table[("rules", "*", "*", "*", -1)] == (0, 4, 0)
