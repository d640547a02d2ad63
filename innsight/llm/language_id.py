"""Language ID by compression (operator 4).

Each language has a raw-content zstandard dictionary made of training texts. A text is
encoded with every dictionary; the language whose dictionary encodes it smallest is chosen,
and the decision is rejected when the runner-up is within ``MIN_MARGIN`` of it.

What is encoded are all words of the whole text, repeats too, lower-cased and parted by one space; what
is no letter (or mark on one) costs the same in every language and would only thin out the margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from innsight.llm.common import by_content, documents, id_remainder, text_or_empty

#: Bytes of training text in a dictionary; the models are this bounded sample, nothing more.
DICTIONARY_BYTES = 192 << 10
#: Distinct texts a language may send to the driver (in expectation) as candidates for its dictionary.
DICTIONARY_ROWS = 800
#: Characters that one training text may give to its dictionary: a longer one gives a stretch of so many.
DICTIONARY_CHARS = 16 << 10
#: Least share of the smaller size by which the runner-up must be larger.
MIN_MARGIN = 0.005
LEVEL = 6
#: Equal sizes are encoded again at this level before they count as a tie.
TIE_LEVEL = 19
#: How fast a language's weight in the score falls with its relative excess size.
SHARPNESS = 40.0
UNDETERMINED = "und"
#: What words consist of: letters and the marks on them, as Unicode has them; a number sign such as a half is neither.
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def encoded_words(text: str) -> str:
    """The text's words in order, lower-cased, of letters only; empty if it has no letter."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip() if _LETTER.search(text) else ""


def train_dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """Raw dictionary of each non-null lang of (doc_id, text, lang).

    A language's distinct texts are taken in the order of a hash of the text until ``DICTIONARY_BYTES``
    are full, so copies count once. About ``DICTIONARY_ROWS`` per language travel, found by a hash threshold set from
    the number of its distinct texts, so no language is sorted. A text of more than ``DICTIONARY_CHARS`` gives a stretch
    of so many characters, which starts where its hash says: a language all of whose texts are long is learned as well.
    """
    usable = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    usable = usable.select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang", "h").agg(F.lit(1)).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    span = float(1 << 63)
    reach = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, DICTIONARY_ROWS / n))])
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - DICTIONARY_CHARS + 1, F.lit(1))).cast("int") + 1
    chosen = usable.where(F.col("h") / span * 0.5 + 0.5 <= reach[F.col("lang")])
    chosen = chosen.select("lang", "h", F.col("text").substr(start, F.lit(DICTIONARY_CHARS)).alias("text"))
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h")
    out: dict[str, bytearray] = {lang: bytearray() for lang in counts}
    for row in chosen.toLocalIterator():
        kept, text = out[row["lang"]], encoded_words(row["text"]).encode()
        if text and len(kept) + len(text) < DICTIONARY_BYTES:
            kept += text + b" "
    return {lang: bytes(kept) for lang, kept in sorted(out.items()) if kept}


class Classifier:
    """Encodes texts with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.encoders, self.closer = ([_encoder(dictionaries[lang], level) for lang in self.langs] for level in (LEVEL, TIE_LEVEL))

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); ties go to the first language by code point."""
        words = encoded_words(text or "").encode()
        if not self.langs or not words:
            return UNDETERMINED, 0.0, 0.0
        sizes = [len(encoder.compress(words)) for encoder in self.encoders]
        if sizes.count(min(sizes)) > 1:
            sizes = [len(encoder.compress(words)) for encoder in self.closer]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1:]
        margin = (min(rest) - sizes[best]) / sizes[best] if rest else 1.0
        # each language's weight falls with its excess size, relative to the smallest
        return self.langs[best], 1.0 / sum(math.exp(-SHARPNESS * (s - sizes[best]) / sizes[best]) for s in sizes), margin


def _encoder(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and accepted for every row of ``docs``.

    Defined cases: a null or empty text, or one without a letter, is ``und``, score 0, not
    accepted; equal sizes go to the first language by code point and have margin 0, so they aren't
    accepted; with one language learned it is chosen at margin 1; with none all is ``und``;
    repeated rows and null ids are rows like others; other columns are left out.
    """
    models = docs.sparkSession.sparkContext.broadcast(dictionaries)  # languages x DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(models.value)
        for batch in batches:
            decided = [classifier.decide(text.as_py()) for text in batch.column(1)]
            lang, score, margin = zip(*decided, strict=True) if decided else ((), (), ())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], ["doc_id", "lang_pred", "score", "margin"])

    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    out = own.mapInArrow(run, "doc_id bigint, lang_pred string, score double, margin double")
    return out.withColumn("accepted", _accepted(F.col("lang_pred"), F.col("margin"), min_margin))


def _accepted(lang, margin, min_margin: float):
    return (lang != UNDETERMINED) & (margin >= min_margin)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose id's remainder isn't the held-out one."""
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    return own.where(id_remainder(F.col("doc_id"), 4) != 2)


def accepted(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Rows of ``docs`` whose language is told with enough margin, learned from their own labels.

    A filter: only texts go to Python, and only a yes or no comes back. Defined cases as in ``identify``; all columns stay,
    whatever their names, and repeated rows stay repeated.
    """
    models = docs.sparkSession.sparkContext.broadcast(train_dictionaries(training_rows(docs)))

    @F.arrow_udf(BooleanType())
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = Classifier(models.value)
        for part in texts:
            decided = (classifier.decide(text.as_py()) for text in part)
            yield pa.array([_accepted(lang, margin, min_margin) for lang, _, margin in decided], pa.bool_())

    rows = by_content(docs).select("document")
    return rows.where(told(F.coalesce(F.col("document.text").cast("string"), F.lit("")))).select("document.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four remainders."""
    docs = documents(spark, sf_dir)
    out = identify(docs, train_dictionaries(training_rows(docs)))
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "accepted")
