"""Label incoming reviews as they arrive. Stateless: no watermark, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from innsight import config
from innsight.functions.frames import scope, unnest
from innsight.functions.text import text_mentions


def read_review_stream(spark: SparkSession, folder: str, schema: StructType,
                       fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(folder)


def reject_reason(limit: int = config.TEXT_LIMIT):
    text = F.col("text")
    return (F.when(text.isNull() | (F.length(text) == 0), "empty text")
            .when(F.length(text) > limit, f"text longer than {limit} characters"))


def label_stream(reviews: DataFrame, aspects: dict[str, list[str]] | None = None,
                 limit: int | None = None) -> DataFrame:
    """Mentions of accepted reviews, plus one row with ``rejected`` per refused review.

    The same projection serves batch and streaming frames. A caller with a length rule, such
    as a web form, sets ``limit``.
    """
    keep = [*scope(reviews), "review_id", "property_id", "date"]
    reason = reject_reason(limit) if limit is not None else F.when(
        F.col("text").isNull() | (F.length("text") == 0), "empty text")
    judged = reviews.withColumn("rejected", reason)
    found = F.when(F.col("rejected").isNull(), text_mentions(F.col("text"), aspects)).otherwise(
        F.array(F.struct(F.lit(None).cast("string").alias("aspect"),
                         F.lit(None).cast("int").alias("sentiment"),
                         F.lit(None).cast("string").alias("sentence"))))
    return unnest(judged, [*keep, "rejected"], found).select(
        *keep, "aspect", "sentiment", "sentence", "rejected")


def start_labelling(labelled: DataFrame, out: str, checkpoint: str,
                    available_now: bool = False) -> StreamingQuery:
    """Append labelled mentions to a parquet folder; the checkpoint makes it exactly-once."""
    writer = (labelled.writeStream.outputMode("append").format("parquet")
              .option("checkpointLocation", checkpoint).option("path", out))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
