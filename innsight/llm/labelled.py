"""Training rows of the text classifiers: a bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.common import id_remainder

#: Labelled rows that a classifier is fitted on at most (in expectation), and the longest text among them.
TRAIN_ROWS = 5_000
TRAIN_CHARS = 30_000
HELD_OUT_OF = 5


def held_out(doc_id: str = "doc_id"):
    return id_remainder(F.col(doc_id), HELD_OUT_OF) == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of rows that aren't held out: a fixed hash sample of about ``rows`` of them.

    The id is hashed, only for choosing, so all rows of one id are chosen together; rows without a label and texts of
    more than ``TRAIN_CHARS`` are left out.
    """
    marks = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels[label].cast("int").alias("label"))
    marks = marks.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    usable = F.length("text") <= TRAIN_CHARS
    n = marks.count()
    share = F.xxhash64("doc_id") / float(1 << 64) + 0.5
    marks = marks.where(share < min(1.0, rows / max(1, n)))  # chosen before any text moves
    found = own.where(usable).join(F.broadcast(marks), "doc_id").orderBy("doc_id", "text", "label").collect()  # about ``rows`` rows
    return [r["text"] for r in found], [1 if r["label"] else 0 for r in found]
