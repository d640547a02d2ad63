"""Text normalisation, clause splitting, aspect and sentiment as native Column expressions.

Nothing here runs Python per row: every function returns an expression that Spark
evaluates in the JVM, so labelling is a projection with no shuffle.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from innsight import config

# The whitespace that separates words: ASCII space, separators, file/record marks, NEL.
BLANK = "[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"
LETTER = "a-z\\x{900}-\\x{97f}'"
WORD_CHAR = "\\p{L}\\p{N}_"
# Unicode noncharacters, reserved for internal use: they never occur in real text.
CUT, TURN = "﷐", "﷑"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_array(values: Sequence[str]) -> Column:
    return F.lit(list(values)) if values else F.array().cast("array<string>")


# --- NFC ------------------------------------------------------------------------------


def _coarse_class(points: Sequence[int], gap: int = 0x600) -> str:
    """A few wide ranges that cover all points: cheap to test, refined by table lookup."""
    spans: list[list[int]] = []
    for p in sorted(points):
        if spans and p - spans[-1][1] < gap:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


@functools.cache
def _nfc_tables() -> tuple[dict[str, str], dict[str, str]]:
    """(characters that NFC rewrites, base+mark pairs that NFC composes), by rule."""
    rewritten, composed = {}, {}
    for point in range(0xA0, 0x30000):
        ch = chr(point)
        if 0xAC00 <= point <= 0xDFFF or unicodedata.is_normalized("NFC", ch) and not (
            unicodedata.decomposition(ch)
        ):
            continue
        nfc = unicodedata.normalize("NFC", ch)
        if nfc != ch:
            rewritten[ch] = nfc
            continue
        parts = unicodedata.decomposition(ch)
        if parts and not parts.startswith("<") and " " in parts:
            pair = "".join(chr(int(code, 16)) for code in parts.split())
            composed[pair] = ch
    return rewritten, composed


def _replace_matches(text: Column, pattern: str, table: dict[str, str]) -> Column:
    lookup = F.str_to_map(F.lit(CUT.join(k + TURN + v for k, v in table.items())),
                          F.lit(CUT), F.lit(TURN))
    return F.aggregate(
        F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
        text,
        lambda acc, hit: F.replace(acc, hit, F.coalesce(F.try_element_at(lookup, hit), hit)),
    )


def nfc(text: Column) -> Column:
    """Canonical composition for non-ASCII rows; ASCII rows pass through untouched.

    Covers rewritten characters and base+mark pairs (two marks deep); conjoining Hangul
    jamo and marks typed out of canonical order are left as they are.
    """
    rewritten, composed = _nfc_tables()
    single = _coarse_class([ord(k) for k in rewritten])
    out = F.when(text.rlike(single), _replace_matches(text, single, rewritten)).otherwise(text)
    for _ in range(2):
        out = F.when(text.rlike(r"\p{M}"), _replace_matches(out, r"(?s).\p{M}", composed)
                     ).otherwise(out)
    return F.when(_beyond_latin(text) & text.rlike(f"{single}|\\p{{M}}"), out).otherwise(text)


def _beyond_latin(text: Column) -> Column:
    """Has the text a character from U+0300 on? All that NFC changes and all emoji are.

    In an ASCII text every character is one byte, which is counted far faster than an expression looks.
    """
    return (F.octet_length(text) != F.char_length(text)) & text.rlike("[^\\x{0}-\\x{2ff}]")


# --- T1-T5: normalise, split, tokenise, language ---------------------------------------


def collapse_blanks(text: Column) -> Column:
    # A single space stays as it is, so only other blanks and runs are matches; most characters fail the first test.
    other = f"(?=[^!-~])(?: (?={BLANK})|[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}&&[^ ]]){BLANK}*"
    return F.trim(F.regexp_replace(text, other, " "))


def normalise(text: Column) -> Column:
    """NFC, lower case, emoji to words, shorthand spellings, single spaces."""
    return bind(text, _normalised)


def _normalised(text: Column) -> Column:
    emoji = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in config.EMOJI_RANGES) + "]"

    def without_emoji(lowered: Column) -> Column:
        worded = lowered
        for symbol, word in config.EMOJI_WORDS.items():
            worded = F.replace(worded, F.lit(symbol), F.lit(word))
        return F.when(_beyond_latin(lowered) & lowered.rlike(emoji), F.regexp_replace(worded, emoji, " ")).otherwise(lowered)

    by_target: dict[str, list[str]] = {}
    for variant, target in config.SPELLING.items():
        by_target.setdefault(target, []).append(variant)

    def spelled(out: Column) -> Column:
        new = out
        for target, variants in by_target.items():
            new = F.regexp_replace(
                new, f"(?:^|(?<= ))(?:{'|'.join(map(re.escape, variants))})(?= |$)", target)
        # Words are apart by one space now, so literals tell whether there is anything to spell.
        padded = bind(F.concat(F.lit(" "), out, F.lit(" ")), lambda p: _holds_any(p, [f" {w} " for w in config.SPELLING]))
        return F.when(padded, new).otherwise(out)

    return bind(collapse_blanks(bind(F.lower(nfc(text)), without_emoji)), spelled)


def _holds_any(text: Column, words: Sequence[str]) -> Column:
    """Does the text hold one of the literals? One that holds another is found by the shorter."""
    least = [w for w in words if not any(v != w and v in w for v in words)]
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in least])


def normalise_words(value: str) -> str:
    """The same form for a configured cue, on the driver (cues hold no emoji)."""
    words = unicodedata.normalize("NFC", value.lower()).split()
    return " ".join([config.SPELLING.get(word, word) for word in words])


def mark_clauses(text: Column) -> Column:
    """Replace every separator run by CUT, or by TURN if it holds a contrast word."""
    return bind(text, _marked)


def _cut(also: str = "") -> str:
    """A separator: a run of marks (or of ``also``), or a joining word."""
    marks, joins = f".!?;,\\n{also}", "|".join(config.JOINING_WORDS)
    firsts = "".join(sorted({w[0] for w in config.JOINING_WORDS}))
    return f"(?=[{marks}{firsts}])(?:[{marks}]+|(?<![{WORD_CHAR}])(?:{joins})(?![{WORD_CHAR}]))"


def _may_turn(text: Column) -> Column:
    return _holds_any(text, [*config.CONTRAST_WORDS, TURN])


def _marked(text: Column) -> Column:
    # Leading lookaheads on the possible first characters fail fast at most positions.
    starts, seconds = ("".join(sorted({w[i] for w in config.CONTRAST_WORDS})) for i in (0, 1))
    turn = (f"(?=[{starts}][{seconds}])(?<![{LETTER}])(?:{'|'.join(config.CONTRAST_WORDS)})"
            f"(?![{LETTER}])")
    cut = _cut()
    cut_only = F.regexp_replace(F.regexp_replace(text, cut, CUT), f"\\s*{CUT}[\\s{CUT}]*", CUT)
    out = F.regexp_replace(F.regexp_replace(text, turn, TURN), cut, CUT)
    out = F.regexp_replace(out, f"[\\s{CUT}]*{TURN}[\\s{CUT}{TURN}]*", TURN)
    both = F.regexp_replace(out, f"\\s*{CUT}[\\s{CUT}]*", CUT)
    # Finding a literal is far cheaper than the expressions: texts without a contrast word skip two of them.
    return F.when(_may_turn(text), both).otherwise(cut_only)


def _runs(norm: Column) -> Column:
    """Runs of clauses of a normalised text, each still holding its TURNs; blanks around them, and blank ones, are left in.

    A text without a contrast word is split where it would be marked, which saves two passes over it.
    """
    return bind(norm, lambda t: F.when(_may_turn(t), F.split(mark_clauses(t), CUT)).otherwise(F.split(t, _cut(CUT))))


def split_clauses(text: Column) -> Column:
    """array<struct<clause, after_contrast>> of a normalised text."""
    pieces = F.split(F.replace(mark_clauses(text), F.lit(TURN), F.lit(CUT + TURN)), CUT)
    flagged = F.transform(pieces, lambda p: F.struct(
        F.trim(F.replace(p, F.lit(TURN), F.lit(""))).alias("clause"),
        F.startswith(p, F.lit(TURN)).alias("after_contrast"),
    ))
    return F.filter(flagged, lambda c: c["clause"] != "")


def split_sentences(text: Column) -> Column:
    return F.transform(split_clauses(text), lambda c: c["clause"])


def tokenise(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{LETTER}]+"), F.lit(0))


def language_hint(text: Column) -> Column:
    return (
        F.when(text.rlike("[\\x{900}-\\x{97f}]"), "hi")
        .when(F.lower(text).rlike("|".join(config.HINGLISH_MARKERS)), "hinglish")
        .otherwise("en")
    )


# --- T6: aspects of one clause ----------------------------------------------------------


def _split_cues(cues: Sequence[str]) -> tuple[list[str], list[str]]:
    whole, inside = [], []
    for cue in map(normalise_words, cues):
        target = inside if re.search(r"[ -]", cue) or not cue.isascii() else whole
        if cue not in target:
            target.append(cue)
    return whole, inside


def clause_aspects(clause: Column, tokens: Column, aspects: dict[str, list[str]]) -> Column:
    """Aspects a clause names, in taxonomy order."""
    hits = []
    for name, cues in aspects.items():
        whole, inside = _split_cues(cues)
        found = F.arrays_overlap(tokens, literal_array(whole)) if whole else F.lit(False)
        for phrase in inside:
            found = found | F.contains(clause, F.lit(phrase))
        hits.append(F.when(found, F.lit(name)))
    return F.array_compact(F.array(*hits))


def _names_any(text: Column, aspects: dict[str, list[str]]) -> Column:
    """Can any clause of the text name an aspect? One look for all cues at once, where tokens cost many."""
    whole = [w for w in cue_words(aspects) if re.fullmatch("[a-z']+", w)]  # others are no token
    inside = sorted({w for cues in aspects.values() for w in _split_cues(cues)[1]})
    found = F.lit(False)
    if whole:
        starts = "".join(sorted({w[0] for w in whole}))
        found = text.rlike(f"(?=[{starts}])(?<![{LETTER}])(?:{'|'.join(whole)})(?![{LETTER}])")
    return found | _holds_any(text, inside) if inside else found


def cue_words(aspects: dict[str, list[str]]) -> list[str]:
    return sorted({w for cues in aspects.values() for w in _split_cues(cues)[0]})


# --- T8: sentiment of one clause --------------------------------------------------------


def rule_sentiment(
    clause: Column, tokens: Column, lexicon: dict[str, list[str]] | None = None
) -> Column:
    """Lexicon score of one clause, as its sign: a fold over the clause's tokens.

    State: running score, tokens still under a preceding negator, distance to and sign of
    the latest sentiment word (sign 0 = none to take back).
    """
    words = lexicon or config.LEXICON
    score = F.lit(0)
    for phrase in words["positive_phrases"]:
        score = score + F.contains(clause, F.lit(phrase)).cast("int")
    for phrase in words["negative_phrases"]:
        score = score - F.contains(clause, F.lit(phrase)).cast("int")

    def has(token: Column, group: Sequence[str]) -> Column:
        return F.array_contains(literal_array(group), token)

    coded = F.transform(tokens, lambda t: F.when(has(t, words["post_negation"]), 3)
                        .when(has(t, words["negation"]), 2)
                        .when(has(t, words["positive"]), 1)
                        .when(has(t, words["negative"]), -1).otherwise(0))

    def state(total: Column, span: Column, gap: Column, sign: Column) -> Column:
        return F.struct(total.cast("int").alias("total"), span.cast("int").alias("span"),
                        gap.cast("int").alias("gap"), sign.cast("int").alias("sign"))

    def step(acc: Column, code: Column) -> Column:
        takes_back = (code == 3) & (acc["sign"] != 0) & (acc["gap"] <= config.POST_NEGATION_WINDOW)
        delta = F.when(acc["span"] > 0, -code).otherwise(code)
        return (
            F.when(takes_back, state(acc["total"] - 2 * acc["sign"], acc["span"],
                                     acc["gap"] + 1, F.lit(0)))
            .when(code >= 2, state(acc["total"], F.lit(config.NEGATION_SPAN),
                                   acc["gap"] + 1, acc["sign"]))
            .when(code != 0, state(acc["total"] + delta, F.greatest(acc["span"] - 1, F.lit(0)),
                                   F.lit(1), delta))
            .otherwise(state(acc["total"], F.greatest(acc["span"] - 1, F.lit(0)),
                             acc["gap"] + 1, acc["sign"]))
        )

    zero = F.lit(0)
    # A clause with no scoring word keeps the phrase score: skip the fold.
    scoring = literal_array([*words["positive"], *words["negative"]])
    walked = F.when(
        F.arrays_overlap(tokens, scoring),
        F.aggregate(coded, state(zero, zero, zero, zero), step, lambda acc: acc["total"]),
    ).otherwise(0)
    return F.signum((score + walked).cast("double")).cast("int")


# --- T6-T8 together: all mentions of one text --------------------------------------------

ClauseScorer = Callable[[Column, Column], Column]


def aspect_clauses(norm: Column, aspects: dict[str, list[str]]) -> Column:
    """array<struct<clause, tokens, aspects>> of the clauses that carry an aspect.

    Cutting first at plain separators leaves runs of clauses linked by contrast words; a
    clause without an aspect of its own takes the nearest earlier one's in its run.
    """
    cues = literal_array(cue_words(aspects))

    def piece(raw: Column) -> Column:
        clause = F.trim(raw)
        return F.struct(clause.alias("clause"), tokenise(clause).alias("tokens"))

    def cue(p: Column) -> Column:
        return F.struct(p["clause"].alias("clause"), p["tokens"].alias("tokens"),
                        F.array_intersect(p["tokens"], cues).alias("cues"))

    def own(p: Column) -> Column:
        return F.struct(p["clause"].alias("clause"), p["tokens"].alias("tokens"),
                        clause_aspects(p["clause"], p["cues"], aspects).alias("own"))

    # Without an aspect of its own a run has none to pass on either.
    runs = F.transform(
        F.filter(_runs(norm), lambda run: _names_any(run, aspects)),
        lambda run: F.transform(F.transform(F.transform(F.split(run, TURN), piece), cue), own))

    def resolve(run: Column) -> Column:
        def inherit(p: Column, i: Column) -> Column:
            earlier = F.filter(F.slice(run, F.lit(1), i + 1), lambda q: F.size(q["own"]) > 0)
            inherited = F.when(F.size(p["own"]) > 0, p["own"]).otherwise(
                F.try_element_at(earlier, F.lit(-1))["own"])
            return F.struct(p["clause"].alias("clause"), p["tokens"].alias("tokens"),
                            inherited.alias("aspects"))
        return F.transform(run, inherit)

    return F.filter(F.flatten(F.transform(runs, resolve)),
                    lambda c: (c["clause"] != "") & (F.size(c["aspects"]) > 0))


def text_mentions(
    text: Column,
    aspects: dict[str, list[str]] | None = None,
    sentiment: ClauseScorer | None = None,
) -> Column:
    """array<struct<aspect, sentiment, sentence>> of one raw text, clause by clause."""
    score = sentiment or rule_sentiment
    scored = F.transform(
        aspect_clauses(normalise(text), aspects or config.ASPECTS),
        lambda c: F.struct(c["clause"].alias("clause"), c["aspects"].alias("aspects"),
                           score(c["clause"], c["tokens"]).alias("score")),
    )
    return F.flatten(F.transform(scored, lambda c: F.transform(
        c["aspects"],
        lambda a: F.struct(a.alias("aspect"), c["score"].alias("sentiment"),
                           c["clause"].alias("sentence")))))


def clean_social(text: Column) -> Column:
    """Drop tokenised URLs and @mentions, collapse blanks."""
    out = F.regexp_replace(text, r"https? : / / \S+(?: [./] \S+)*", " ")
    return collapse_blanks(F.regexp_replace(out, r"@ \S+", " "))


def ngram_features(text: Column) -> Column:
    """Word 1-2-grams (``w:``) and within-word character 2-5-grams (``c:``)."""
    lo, hi = config.CHAR_NGRAMS

    def grams_of(padded: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        return F.when(
            F.length(padded) >= n,
            F.transform(starts, lambda i: F.concat(F.lit("c:"), F.substr(padded, i, F.lit(n)))),
        ).otherwise(F.array().cast("array<string>"))

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return bind(padded, lambda p: F.concat(*[grams_of(p, n) for n in range(lo, hi + 1)]))

    def features(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)),
                           lambda a, b: F.concat(F.lit("w:"), a, F.lit(" "), b))
        return F.concat(
            F.transform(words, lambda w: F.concat(F.lit("w:"), w)),
            F.array_compact(pairs), F.flatten(F.transform(words, grams)))

    return bind(tokenise(normalise(F.coalesce(text, F.lit("")))), features)
