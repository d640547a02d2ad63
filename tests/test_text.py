import unicodedata

import pytest
from pyspark.sql import functions as F

from innsight import config
from innsight.functions import text as tx
from innsight.operators import labels


def rows(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["x"] for r in df.select("i", expr(F.col("text")).alias("x")).orderBy("i").collect()]


MENTIONS = {
    "Khana accha tha lekin kamra ganda tha.": {("Food", 1), ("Room", -1), ("Cleanliness", -1)},
    "Khaana bahut swadisht tha but room thanda tha.": {("Food", 1), ("Room", -1)},
    "कमरा साफ़ था और view zabardast tha.": {("Room", 1), ("Location", 1), ("Cleanliness", 1)},
    "Heater kaam nahi kar raha tha, raat bhar thand lagi.": {("Room", -1)},
    "Staff bahut helpful tha, paisa vasool.": {("Staff", 1), ("Value for Money", 1)},
    "Khaana accha nahi tha.": {("Food", -1)},
    "Staff was friendly but slow.": {("Staff", 1), ("Staff", -1)},
    "Food was tasty but cold.": {("Food", 1), ("Food", -1)},
    "The room was clean. Terrible trip!": {("Room", 1), ("Cleanliness", 1)},
}
SENTIMENT = {
    "the food was not good": -1, "the food was good": 1, "Kamra saaf nahi tha": -1,
    "Staff bilkul helpful nahi tha": -1, "khana accha nahin tha": -1, "room clean nhi tha": -1,
    "koi problem nahi": 1, "nahi accha laga": -1, "Heater kaam nahi kar raha tha": -1,
    "service achi nahi thi": -1, "khana achi thi": 1, "कमरा साफ़ नहीं था": -1,
}


def test_mentions(spark):
    got = rows(spark, MENTIONS, tx.text_mentions)
    assert [{(m["aspect"], m["sentiment"]) for m in g} for g in got] == list(MENTIONS.values())


def test_clause_sentiment(spark):
    def score(text):
        norm = tx.normalise(text)
        return tx.rule_sentiment(norm, tx.tokenise(norm))
    assert rows(spark, SENTIMENT, score) == list(SENTIMENT.values())


@pytest.mark.parametrize("text", ["the butter chicken was fresh", "mall road par hai", "मगरमच्छ"])
def test_never_split(spark, text):
    assert rows(spark, [text], lambda t: F.size(tx.split_clauses(t))) == [1]


def test_contrast_flags(spark):
    got = rows(spark, ["but cold. , but , hot or dry"], lambda t: tx.split_clauses(tx.normalise(t)))
    assert [(c["clause"], c["after_contrast"]) for c in got[0]] == [
        ("cold", True), ("hot", True), ("dry", False)]


def test_normalise(spark):
    texts = ["  Food \U0001f60a  NHI nhi, ", "saaf-safai ✨ ok", "Café CRÈME",
             "क़ क़ ऩ", None]
    got = rows(spark, texts, tx.normalise)
    assert got[:3] == ["food good nahi nhi,", "saaf safai ok", "café crème"]
    assert got[3] == unicodedata.normalize("NFC", texts[3])
    assert got[4] is None


def test_language(spark):
    got = rows(spark, ["कमरा", "Khana was ok", "fine"], tx.language_hint)
    assert got == ["hi", "hinglish", "en"]


def test_features(spark):
    got = rows(spark, ["Khana ACCHA tha", None, ""], tx.ngram_features)
    assert {"w:khana", "w:khana accha", "c: kh"} <= set(got[0])
    assert got[1] == [] and got[2] == []
    words = ["khana", "accha", "tha"]
    grams = [f" {w} "[i:i + n] for w in words for n in range(2, 6)
             for i in range(len(w) + 3 - n)]
    want = [f"w:{w}" for w in words] + ["w:khana accha", "w:accha tha"] + [f"c:{g}" for g in grams]
    assert sorted(got[0]) == sorted(want)


def test_label_reviews_and_batch_scorer(spark):
    df = spark.createDataFrame(
        [(1, "A", "2024-01-01", "Food was good. Room bad."), (2, "A", "2024-01-02", None),
         (3, "B", "2024-01-03", "Food was good.")],
        "review_id int, property_id string, date string, text string")
    rule = labels.label_reviews(df).collect()
    assert [(r["review_id"], r["aspect"], r["sentiment"]) for r in rule] == [
        (1, "Food", 1), (1, "Room", -1), (3, "Food", 1)]
    model = labels.label_with_model(df, lambda clauses: [0] * len(clauses))
    assert {(r["review_id"], r["aspect"], r["sentiment"]) for r in model.collect()} == {
        (1, "Food", 0), (1, "Room", 0), (3, "Food", 0)}
    with pytest.raises(Exception, match="one score per clause"):
        labels.label_with_model(df, lambda clauses: [0]).collect()


def test_classify_text(spark):
    assert labels.classify_text(spark, "").columns == ["aspect", "sentiment", "sentence"]
    assert labels.classify_text(spark, None).count() == 0
    with pytest.raises(ValueError):
        labels.classify_text(spark, 3)
