"""Driver tables (star schema, documents, labels) as reviews, mentions and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A small taxonomy and lexicon of words that do occur in the generated documents.
TEST_ASPECTS = {
    "Article": ["the", "des", "die"],
    "Preposition": ["with", "for", "pour", "mit"],
    "Pronoun": ["this", "that", "be is", "une"],
    "Verb": ["was", "are", "est", "ist"],
}
TEST_LEXICON = {
    "positive": ["of", "on", "par", "und"],
    "negative": ["in", "by", "dans", "von"],
    "positive_phrases": ["and the"],
    "negative_phrases": ["to be"],
    "negation": ["not", "no", "as"],
    "post_negation": ["it", "que"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of a table's files, about so many bytes go to one task.
BYTES_PER_TASK = 4 << 20


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal a table's rows to tasks of a few megabytes: a scan alone can't split a row group, however many rows it holds.

    The plan's own size estimate sets their number, so a task's work does not grow with the table.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(16, -(-size // BYTES_PER_TASK)))


def _line_mentions(lines: DataFrame) -> list:
    quantity = F.col("l_quantity")
    return [
        F.col("l_shipdate").cast("date").alias("date"),
        F.concat("l_returnflag", "l_linestatus").alias("aspect"),
        F.when(quantity < 17, -1).when(quantity < 34, 0).otherwise(1).alias("sentiment"),
    ]


def mentions_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention per line item: an order reviews a supplier."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("review_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("property_id"),
        *_line_mentions(lines))


def _nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key lookup table is small at every size seen, but the choice is left to the
    # optimizer, which knows its bytes.
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)


def mentions_nation(spark: SparkSession, sf_dir: str, planted: bool = False,
                    by_region: bool = False) -> DataFrame:
    """Line items of a nation's suppliers; an order's items of one month are one review.

    ``planted`` forces negative sentiment where known patterns should be found;
    ``by_region`` adds the nation's region as ``cluster_id``.
    """
    lines = _nation_lines(spark, sf_dir)
    keys = []
    if by_region:
        nation = table(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("s_nationkey"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("cluster_id"))
        lines = lines.join(nation, "s_nationkey")
        keys = ["cluster_id"]
    date = F.col("l_shipdate").cast("date")
    rows = lines.select(
        *keys,
        (F.col("l_orderkey") * 100000 + F.year(date) * 12 + F.month(date)).alias("review_id"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("property_id"),
        *_line_mentions(lines), F.col("s_nationkey").alias("nation"))
    if planted:
        day, aspect, nation = F.col("date"), F.col("aspect"), F.col("nation")
        bad = (
            ((aspect == "RF") & (nation == 7) & (day >= F.lit("1999-06-01").cast("date")))
            | ((aspect == "AO") & (F.month(day) == 12))
            | ((aspect == "NO") & nation.isin(8, 10, 12, 23)
               & (day >= F.lit("1999-03-01").cast("date")))
            | ((aspect == "NF") & (day >= F.lit("1998-07-01").cast("date")))
        )
        rows = rows.withColumn("sentiment", F.when(bad, -1).otherwise(F.col("sentiment")))
    return rows.drop("nation")


def mentions_planted(spark: SparkSession, sf_dir: str, by_region: bool = False) -> DataFrame:
    return mentions_nation(spark, sf_dir, planted=True, by_region=by_region)


def reviews_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews: a source is a property, a language a platform."""
    return spread_scan(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("property_id"),
        F.col("lang").alias("platform"),
        F.date_add(F.lit("2024-01-01").cast("date"),
                   (F.col("doc_id") * 7 % 700).cast("int")).alias("date"),
        (1 + F.col("doc_id") % 5).cast("double").alias("rating"),
        "text",
        F.col("lang").alias("language_hint"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position per nation that has suppliers."""
    k = F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select("s_nationkey").distinct().select(
        F.concat(F.lit("N"), k.cast("string")).alias("property_id"),
        (F.lit(30.445) + (k * 37 % 100) * F.lit(0.00023)).alias("lat"),
        (F.lit(78.03) + (k * 53 % 100) * F.lit(0.0007)).alias("lon"),
        F.concat(F.lit("Z"), (k % 5).cast("string")).alias("zone"))


def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label cells in the annotation format, derived from the labels table."""
    q, t = F.col("quality"), F.col("toxic")
    aspects = F.when(q == 1, F.when(t == 1, "Article;Verb").otherwise("article; Preposition")
                     ).otherwise(F.when(t == 1, "none").otherwise(""))
    cells = F.when(q == 1, F.when(t == 1, "Article=-1;Verb=0").otherwise("Article=1;Preposition=1")
                   ).otherwise("")
    notes = F.when(F.col("doc_id") % 7 == 0, "Sarcasm").when(
        F.col("doc_id") % 11 == 0, "very short review").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return table(spark, sf_dir, "labels").join(docs, "doc_id", "left").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".0")).alias("review_id"),
        aspects.alias("gold_aspects"), cells.alias("gold_sentiment_per_aspect"),
        notes.alias("notes"), "text")
