"""Personal data by bootstrapped contextual extraction (operator 1).

Plain patterns find the base identifiers; these are the seeds. The words around a seed and the form of
what stands between them are lexical patterns, from the narrow (two words before it) to the wide (the word before it, the form
alone), and every other identifier-like token that fits the same pattern is a candidate. Wide patterns need more support.
Spark scores the graph of patterns and instances in turns: a pattern is worth the share of
its instances that are known or believed, an instance what its patterns are worth together. After the last
turn the candidates that stand in trusted patterns are spans as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.common import documents, slices, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern is trusted with so many believed instances and this score; ``DOUBT`` is added to its instances.
LEAST_SUPPORT, LEAST_SCORE, DOUBT = 5, 0.7, 1.0
#: The believed instances that a pattern of one word needs, marked by ``WIDE`` at its front.
WIDE_SUPPORT, WIDE = 20, "*"
#: An instance is believed from this score on.
BELIEVED = 0.8
#: Characters on each side of a span whose words are its context.
CONTEXT_CHARS = 60
#: An instance of more characters is known by its digest in the graph.
INSTANCE_CHARS = 64

# The base identifiers' patterns. Possessive runs, and the search for an address from its @,
# find the same matches in linear time.
_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_MARK = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(r"\S*")
_NUMBER_GROUPS = re.compile(r"(?:[ -][0-9().-]*[0-9])*")
_WORD = re.compile(r"\S+")
_CLASSES = re.compile(r"\d+|[^\W\d_]+")
#: Digits that a candidate has at most.
MOST_DIGITS = 32
_EDGE = ".,;:!?\"'<>[]{}|*#$%&"
_PUNCTUATION = _EDGE + "()=-"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _EMAIL_CHARS:
            start -= 1
        domain = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base identifiers, by kind as in KINDS, then start; code points, end exclusive."""
    out = [("email", *span) for span in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def _could_be(token: str) -> list[str]:
    """Kinds that an identifier-like token has the shape of."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    kinds = []
    if "@" in token[1:-1]:
        kinds.append("email")
    if 4 <= digits <= MOST_DIGITS and token.count(".") + token.count(":") >= 3 and set(token.lower()) <= set("0123456789abcdef.:"):
        kinds.append("ip")
    if not letters and 12 <= digits <= 19:
        kinds.append("card")
    if not letters and 7 <= digits <= 15:
        kinds.append("phone")
    return kinds


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[int, int, list[str]]]:
    """Stretches of ``text`` between ``start`` and ``end`` that could be an identifier: of its words from the left, the most that fit one kind together."""
    words = [m.span() for m in _WORD.finditer(text, start, end)]
    i = 0
    while i < len(words):
        best, digits = None, 0
        for j in range(i, len(words)):
            s, e = words[i][0], words[j][1]
            while s < e and text[s] in _EDGE:
                s += 1
            while e > s and text[e - 1] in _EDGE + "(":
                e -= 1
            if text[s:s + 1] == "(" and ")" not in text[s:e - 1]:  # a bracket around it, or an open one
                s, e = s + 1, e - (text[e - 1] == ")")
            digits += sum(c.isdigit() for c in text[words[j][0]:words[j][1]])
            if s < e and (kinds := _could_be(text[s:e])):
                best = (j + 1, s, e, kinds)
            if digits > MOST_DIGITS:  # no kind has more
                break
        if best:
            yield best[1:]
        i = best[0] if best else i + 1


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, list[str]]]:
    """Identifier-like stretches outside the spans in ``taken``, with the kinds they could be.

    A token with what number groups follow it is cut at the spans taken; what is left is judged in pieces, so that neither a neighbouring
    number nor a base span hides an identifier.
    """
    used = sorted((s, e) for _, s, e in taken)
    out, done, k = [], 0, 0
    mark = _MARK.search(text)
    while mark:
        start = mark.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = _TOKEN_END.match(text, mark.start()).end()
        end = _NUMBER_GROUPS.match(text, end).end()
        done = end
        mark = _MARK.search(text, end)
        while k < len(used) and used[k][1] <= start:
            k += 1
        while k < len(used) and used[k][0] < end:
            out += _pieces(text, start, used[k][0])
            start = max(start, used[k][1])
            if used[k][1] > end:
                break
            k += 1
        out += _pieces(text, start, end)
    return out


def form(kind: str, span: str) -> str:
    """Kind and character classes of a span with their lengths, and whether the kind's own check holds."""
    shape = _CLASSES.sub(lambda m: f"9{len(m.group())}" if m.group()[0].isdigit() else f"a{len(m.group())}", span) if len(span) <= INSTANCE_CHARS else "long"
    digits = _NOT_DIGIT.sub("", span)
    if kind == "card":
        return f"{len(digits)} digits, {'valid' if luhn(digits) else 'invalid'}"
    if kind == "ip":
        return f"{shape.count('.')} dots, {'valid' if all(p.isdigit() and len(p) < 10 and int(p) <= 255 for p in span.split('.')) else 'invalid'}"
    return shape


def patterns(text: str, start: int, end: int, kinds: list[str], context_chars: int = CONTEXT_CHARS) -> list[str]:
    """A span's patterns, narrow ones first: two words before it, the words on both sides, two words after it; then the word before or after it, without
    punctuation; then its form for each of its kinds."""
    before = text[max(0, start - context_chars):start].lower().split()
    after = text[end:end + context_chars].lower().split()
    out = []
    if len(before) > 1:
        out.append(f"{before[-2]} {before[-1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(after) > 1:
        out.append(f"_ {after[0]} {after[1]}")
    if before and (word := before[-1].strip(_PUNCTUATION)):
        out.append(f"{WIDE}{word} _")
    if after and (word := after[0].strip(_PUNCTUATION)):
        out.append(f"{WIDE}_ {word}")
    return out + [f"{WIDE}{kind} {form(kind, text[start:end])}" for kind in kinds]


def _instance(span: str) -> str:
    return span.lower() if len(span) <= INSTANCE_CHARS else hashlib.sha256(span.lower().encode("utf-8", "replace")).hexdigest()


_SPAN = pa.struct([("kinds", pa.list_(pa.string())), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
_SPAN_SQL = "array<struct<kinds:array<string>,start:int,end:int,instance:string,patterns:array<string>>>"


def _read(batches: Iterator[pa.RecordBatch], context_chars: int) -> Iterator[pa.RecordBatch]:
    def span(text: str, start: int, end: int, kinds: list[str]) -> dict:
        return {"kinds": kinds, "start": start, "end": end, "instance": _instance(text[start:end]), "patterns": patterns(text, start, end, kinds, context_chars)}

    for batch in chain.from_iterable(slices(b, "text") for b in batches):
        base, more = [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text)
            base.append([span(text, s, e, [k]) for k, s, e in found])
            more.append([span(text, s, e, kinds) for s, e, kinds in candidates(text, found)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.list_(_SPAN)), pa.array(more, pa.list_(_SPAN))], ["doc_id", "base", "candidates"])


def _edges(read: DataFrame) -> DataFrame:
    """Distinct (pattern, kind, instance, seed): the graph, counted once however often an edge recurs."""
    def of(column: str, seed: bool) -> DataFrame:
        spans = read.select(F.explode(column).alias("s"))
        return spans.select(F.explode("s.patterns").alias("pattern"), "s.kinds", "s.instance").select(
            "pattern", F.explode("kinds").alias("kind"), "instance", F.lit(seed).alias("seed"))

    every = of("base", True).unionByName(of("candidates", False))
    return every.groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed"))


def trusted_patterns(read: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score) of the patterns trusted after ``rounds`` turns over the graph."""
    edges = written(_edges(read), "pii-edges")
    enough = F.when(F.col("pattern").startswith(WIDE), WIDE_SUPPORT).otherwise(LEAST_SUPPORT)
    belief = None
    for _ in range(rounds):
        known = edges.withColumn("belief", F.col("seed").cast("double"))
        if belief is not None:
            known = edges.join(belief, ["kind", "instance"], "left").withColumn(
                "belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0))))
        trusted = written(
            known.groupBy("pattern", "kind").agg(
                (F.sum("belief") / (F.count(F.lit(1)) + DOUBT)).alias("score"), F.sum((F.col("belief") >= BELIEVED).cast("int")).alias("support"))
            .where((F.col("support") >= enough) & (F.col("score") >= LEAST_SCORE)).drop("support"),
            "pii-patterns",
        )
        belief = edges.where(~F.col("seed")).join(trusted, ["pattern", "kind"]).groupBy("kind", "instance").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("belief"))
    return trusted


def extract(docs: DataFrame, rounds: int = ROUNDS, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """doc_id, base and found (arrays of struct kind, start, end) for every row of ``docs``, from whole texts.

    ``base`` holds the plain patterns' spans and always stays; ``found`` those of the bootstrapped
    patterns, which overlap no base span and have one kind each, the one whose pattern scores best (ties:
    first of KINDS). Defined cases: a null text is empty and has no spans; with too few
    seeds no pattern is trusted and ``found`` is empty; repeated rows get the same spans each, but count
    once as instances; null ids are ids like others; an empty table gives no rows; other columns are left out.
    """
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    read = own.mapInArrow(partial(_read, context_chars=context_chars), f"doc_id bigint, base {_SPAN_SQL}, candidates {_SPAN_SQL}")
    read = written(read.withColumn("row", F.monotonically_increasing_id()), "pii-read")
    trusted = trusted_patterns(read, rounds)
    asked = read.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("s"))
    asked = asked.select("row", "s.start", "s.end", F.explode("s.kinds").alias("kind"), "s.patterns")
    asked = asked.select("row", "start", "end", "kind", F.explode("patterns").alias("pattern"))
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    hits = asked.join(trusted, ["pattern", "kind"]).groupBy("row", "start", "end").agg(
        F.min(F.struct((-F.col("score")).alias("s"), rank.alias("r"), "kind")).alias("best"))
    found = hits.groupBy("row").agg(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "end")).alias("found"))
    base = F.transform("base", lambda s: F.struct(s["kinds"][0].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return read.join(found, "row", "left").select("doc_id", base.alias("base"), F.coalesce("found", none).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end by kind, then start, joined by commas."""
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(F.lit(list(KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    out = extract(documents(spark, sf_dir))
    counts = [_count(kind).alias(f"n_{kind}") for kind in KINDS]
    return out.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "found")).alias("spans"), F.size("found").alias("n_found"),
    )
