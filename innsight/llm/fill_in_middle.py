"""Fill-in-the-middle transformation by repeated-capture matching (operator 12).

One ``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of its group, so the list of their
ends has the number of units as its length and both cut offsets as two of its items. Choosing, cutting, marking and
putting back are DataFrame expressions; the text itself never leaves the JVM but for the match.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from innsight.llm.common import documents, text_or_empty

#: A unit is a run of ASCII letters or any one other code point.
# the two exclude each other, so giving nothing back loses no match and keeps no state for it
_UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Of 100 documents, how many are left plain and how many of the others have their suffix first.
PLAIN_OF_100, SUFFIX_FIRST_OF_100 = 10, 20
SEED = "1"


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "last")]))
def _cuts(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """Units, and the code points before the smaller and the larger of two cuts drawn by numbers modulo units + 1."""
    found = []
    for value, x, y in zip(text, one.to_pylist(), other.to_pylist(), strict=True):
        ends = _UNITS.fullmatch(value.as_py()).ends(1)
        n = len(ends)
        ends.append(0)  # index -1: no unit before the cut
        a, b = sorted((x % (n + 1), y % (n + 1)))
        found.append((n, ends[a - 1], ends[b - 1]))
    columns = zip(*found, strict=True) if found else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "last"])


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers of 32 bits for an id (null: empty text): the first digits of the digest of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: str = SEED, plain_of_100: int = PLAIN_OF_100, suffix_first_of_100: int = SUFFIX_FIRST_OF_100,
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for every row of ``docs``.

    The text is cut before two of its units: the output is marked prefix, suffix, middle (psm), suffix, prefix, middle
    (spm) or the text as it is (plain). Defined cases: a null text is empty; an empty text, and one that has a mark
    in it, is plain, so what is put back is always exact; in a plain row prefix_chars and middle_chars are
    null; parts may be empty; a null doc_id draws as empty text; repeated rows are cut alike; an empty table gives no rows;
    other columns are left out. A match holds two numbers per unit of its text.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    marked = F.lit(False)
    for mark in MARKS:
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= 100 - plain_of_100)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first_of_100, "spm").otherwise("psm")
    cut = own.select("doc_id", "text", form.alias("form"), _cuts("text", h1, h2).alias("cut"))
    first, last = F.col("cut.first").cast("int"), F.col("cut.last").cast("int")
    prefix = F.substring("text", F.lit(1), first)
    middle = F.substring("text", first + 1, last - first)
    suffix = F.substring("text", last + 1, F.length("text") - last)
    cut_up = F.col("form") != "plain"
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return cut.select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(cut_up, F.col("cut.first")).alias("prefix_chars"),
        F.when(cut_up, F.col("cut.last") - F.col("cut.first")).alias("middle_chars"), output.otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation. No text that is cut has a mark in it, and marks can't overlap, so each is found once."""
    first_part = lambda text, mark: F.substring_index(text, mark, 1)
    rest = lambda text, mark: F.substring_index(text, mark, -1)
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    middle = rest(body, MIDDLE)
    psm = F.concat(first_part(body, SUFFIX), middle, first_part(rest(body, SUFFIX), MIDDLE))
    spm = F.concat(first_part(rest(body, PREFIX), MIDDLE), middle, first_part(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, as digests of the output and of the text put back from it."""
    return fill_in_middle(documents(spark, sf_dir)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), c AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(u[greatest(x, y) + 1:], '') AS s
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
              ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
