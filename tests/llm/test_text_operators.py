"""Operators that score, tell, extract and encode: against plain versions and on odd rows."""

import hashlib
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from innsight.llm import language_id, pii, quality, sentencepiece_bpe, toxicity
from innsight.llm.labelled import training_sample
from innsight.llm.registry import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def held_out(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(3)
    for alphabet in ("a1.@+ 2-0(é٣", "4539 1488-0343 6467+."):
        for _ in range(5000):
            text = "".join(rng.choice(list(alphabet), rng.integers(0, 40)))
            assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("a" * 100_000 + "1" * 100_000 + "1." * 50_000) is not None  # linear


def test_personal_data_query(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op1_personal_data"](spark, small).collect():
        want = plain_spans(texts[r.doc_id])
        joined = ",".join(":".join(map(str, s)) for s in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not want


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    seeds = [(i, f"word{i} please ring me at +1 555 010 {1000 + i} tomorrow w{i}") for i in range(12)]
    rows = [*seeds, (100, "please ring me at 5550107777 tomorrow"), (101, "part number 5550108888 in stock"), (102, None)]
    found = {r.doc_id: r.found for r in pii.extract(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in found[100]] == [("phone", 18, 28)]
    assert not found[101] and not found[102] and not found[3]


def with_luhn(number):
    return next(f"{number}{c}" for c in range(10) if pii.luhn(f"{number}{c}"))


def test_planted_contexts_are_found_and_decoys_left(spark):
    """Seeds and unseen identifiers share a word, two words or a form; decoys stand in other words or have another form."""
    rng = np.random.default_rng(11)
    noise = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    number = lambda n: "".join(rng.choice(list("123456789"), n))
    rows, want = [], {}

    def plant(before, span, after, kind=None):
        rows.append((len(rows), f"{before} {span} {after}"))
        if kind:
            want[len(rows) - 1] = [(kind, len(before) + 1, len(before) + 1 + len(span))]

    for _ in range(40):
        plant(f"{noise()} phone:", f"+1 555 {number(3)} {number(4)}", noise())  # seeds with one common word
        plant(f"{noise()} pay with", with_luhn(number(15)), noise())
        plant(f"{noise()} mail to", f"{noise()}@{noise()}.org", noise())
    for _ in range(12):  # a trusted pattern has seven known instances of ten
        plant(f"{noise()} phone:", f"555-{number(4)}", noise(), "phone")
        plant(f"{noise()} mail to", f"{noise()}@localhost", noise(), "email")
        plant(f"{noise()} invoice", number(14), noise())
        plant(f"{noise()} part", f"555-{number(4)}", noise())
        plant(f"{noise()} at", f"{noise()}@home", noise())
    long_one = f"{'y' * 90}@localhost"
    plant(f"{noise()} mail to", long_one, noise(), "email")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in pii.extract(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = {(i, s) for i, spans in got.items() for s in spans}
    planted = {(i, s) for i, spans in want.items() for s in spans}
    assert len(found & planted) >= 0.95 * len(planted) and len(found & planted) >= 0.95 * len(found)
    assert (len(rows) - 1, want[len(rows) - 1][0]) in found


def test_neighbouring_numbers_are_judged_one_by_one():
    a, b = with_luhn("411111111111111"), with_luhn("550000000000000")
    text = f"{a} {b} 555-4081 190.137.223.204, (5550107777) x"
    base = pii.base_spans(text)
    spans = [text[s:e] for s, e, _ in pii.candidates(text, base)]
    assert [text[s:e] for _, s, e in base] == ["190.137.223.204"]
    assert spans == [a, b, "555-4081", "5550107777"]
    assert pii.candidates("1 " * 50_000 + "@" * 50_000, []) is not None  # linear
    assert pii.patterns(f"see card: {a}!", 10, 26, ["card"]) == ["see card: _", "card: _ !", "*card _", "*card 16 digits, valid"]


def test_encoding_equals_the_library(spark, small):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coder = sentencepiece_bpe.PieceCodec(open(MODEL, "rb").read())
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab cdé▁\n\t😀ﬁ中 the\x00<s>語ñ"), rng.integers(0, 60))) for _ in range(3000)]
    texts += [" " * k + end for k in range(40) for end in ("", "a", "😀", "\n")] + ["hello" * 4000]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for text in texts:
        ids = coder.encode(text)
        assert ids == lib.encode(text, add_eos=True)
        assert coder.decode(ids) == lib.decode(ids)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(sentencepiece_bpe, "CACHE_PAIRS", 5)
    coder, lib = sentencepiece_bpe.PieceCodec(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "the other words of another thing and the others " * 3
    assert coder.encode(text) == lib.encode(text, add_eos=True)


def test_batches_of_ids_are_decoded_as_the_library_decodes_them():
    coder, lib = sentencepiece_bpe.PieceCodec(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["", " ", "   a", "\n", "a.,b., a, b\u00b2. x,y", "A,", ",", "end.", "\u2581x\u2581", "\U0001f600\U0001f600 \u0915\u093e.", "ab." * 40, "a\x00b, c."]
    ids = [lib.encode(text, add_eos=True) for text in texts]
    assert [coder.encode(text) for text in texts] == ids
    assert coder.decode_all(pa.array(ids, pa.list_(pa.int32()))) == [lib.decode(i) for i in ids]
    assert coder.decode_all(pa.array([], pa.list_(pa.int32()))) == []
    assert all(type(v) is bytes for v in coder._encoded.values())  # small, and nothing for the garbage collector
    assert " end." in coder._encoded and " end" in coder._encoded  # the word is kept without its stop too


def test_encoding_query(spark, small):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op10_sentencepiece"](spark, small).collect():
        ids = lib.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op4_language_id"](spark, sf).collect()
    assert all(r.held_out == (held_out(r.doc_id, 4) == 2) for r in rows)
    mine = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in mine]) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_decision_equals_the_smallest_encoding(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionaries = language_id.train_dictionaries(language_id.training_rows(docs))
    told = {r.doc_id: r for r in language_id.identify(docs, dictionaries).collect()}

    def size(text, lang, level):
        content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text.encode()))

    for r in rows:
        words, word = [], ""
        for c in (r.text or "").lower() + " ":
            if unicodedata.category(c)[0] in "LM":
                word += c
            elif word:
                words, word = [*words, word], ""
        sizes = sorted((size(" ".join(words), lang, language_id.LEVEL), lang) for lang in dictionaries)
        if words and sizes[0][0] < sizes[1][0]:
            assert told[r.doc_id].lang_pred == sizes[0][1]
            assert told[r.doc_id].margin == pytest.approx((sizes[1][0] - sizes[0][0]) / sizes[0][0])


def test_language_of_signs_copies_and_long_texts(spark):
    """Number signs are no letters; a language of long texts only is learned; copies of a text don't crowd out others."""
    rng = np.random.default_rng(5)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(200)] for lang, letters in (("aa", "abcde"), ("kk", "klmno"))}
    say = lambda lang, n: " ".join(rng.choice(words[lang], n))
    ids = [i for i in range(200) if held_out(i, 4) != 2]
    rows = [(i, say("aa", 20_000), "aa") for i in ids[:3]] + [(i, say("kk", 40), "kk") for i in ids[3:20]]
    same = say("kk", 30)
    rows += [(i, same, "kk") for i in ids[20:]]
    dictionaries = language_id.train_dictionaries(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(dictionaries["aa"]) > 40_000 and dictionaries["kk"].decode().count(same) == 1
    assert len(dictionaries["kk"]) > 15 * 40 * 5
    tell = language_id.Classifier(dictionaries).decide
    assert tell(say("aa", 30))[0] == "aa" and tell(say("kk", 30))[0] == "kk"
    for signs in ("½ ²", "Ⅷ", "12 + 3", "\u0301", "_"):
        assert tell(signs) == ("und", 0.0, 0.0)
    assert tell("a" * 20 + " " + say("kk", 60))[0] == "kk"


@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.93), ("op5_quality", "quality", 0.96)])
def test_classifier_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert all(r.held_out == (held_out(r.doc_id, 5) == 0) for r in rows)
    mine = [r for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in mine]) > least
    assert all(0 <= r.score <= 1 for r in rows)


def test_misspellings_share_subwords():
    texts = [f"w{i} calm words here {'horrible' if i % 2 else 'pleasant'} thing v{i}" for i in range(200)]
    scorer = toxicity.Scorer(*toxicity.train(texts, [i % 2 for i in range(200)]).log_odds())
    assert scorer["horriblle"] > 0 > scorer["pleasantt"]
    assert 0 < scorer.score("") < 1


def test_long_words_count_to_their_end():
    texts = [f"w{i} calm words here {'horrible' if i % 2 else 'pleasant'} thing v{i}" for i in range(200)]
    scorer = toxicity.Scorer(*toxicity.train(texts, [i % 2 for i in range(200)]).log_odds())
    for head in ("x" * 64, "calm_words_here_" * 20, "語" * 300):
        for tail in ("", "_thing", "語" * 100):
            assert scorer.score(f"{head}_horrible{tail}") > scorer.score(f"{head}_pleasant{tail}")
    rng = np.random.default_rng(6)
    for n in range(65, 160):
        word = "".join(rng.choice(list("abcdefgh語"), n))
        marked, whole = f"<{word}>", set()
        for size in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
            whole |= {zlib.crc32(marked[k:k + size].encode()) % toxicity.BUCKETS for k in range(len(marked) - size + 1)}
        assert whole <= {g for p in toxicity.words_of(word) for g in toxicity.ngrams(p)}
    assert toxicity.words_of("Short words") == ["short", "words"]
    joined = [f"{'x' * 70}_{'horrible' if i % 2 else 'pleasant'}" for i in range(40)]
    learned = toxicity.Scorer(*toxicity.train(joined, [i % 2 for i in range(40)]).log_odds())
    assert learned.score(joined[1]) > 0.5 > learned.score(joined[0])


def test_flattened_trees_equal_walking_them():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 18))
    forest = quality.grow(x, (x[:, 3] > 0).astype(float), trees=5)
    for row, got in zip(x[:50], forest.log_odds(x[:50]), strict=True):
        total = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += value[node - (2 ** quality.DEPTH - 1)]
        assert np.isclose(total, got)
    assert quality.grow(x, np.ones(500)).scores(x).min() > 0.9  # one class: only a base score


def test_training_rows_are_bounded_and_not_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts, marks = training_sample(docs, labels, "toxic", rows=100)
    assert 50 < len(texts) < 150 and set(marks) <= {0, 1}


def test_odd_rows(spark, odd, none):
    model = toxicity.train(["good day", "bad day"] * 5, [0, 1] * 5)
    forest = quality.train(["a b c", "### $$$"] * 20, [1, 0] * 20)
    dictionaries = language_id.train_dictionaries(language_id.training_rows(odd))
    n = odd.count()
    for out in (toxicity.score(odd, model), quality.score(odd, forest)):
        scores = [r.score for r in out.collect()]
        assert len(scores) == n and all(0 <= s <= 1 for s in scores)
    told = language_id.identify(odd, dictionaries).collect()
    assert len(told) == n and sum(r.lang_pred == "und" and not r.accepted for r in told) >= 4
    spans = pii.extract(odd).where("doc_id = 13").first().base
    assert [s.kind for s in spans] == ["email", "ip", "phone"]
    encoded = sentencepiece_bpe.encode(odd, MODEL)
    assert encoded.count() == n
    assert [r.ids for r in encoded.where("doc_id in (4, 5)").collect()] == [[2], [2]]
    assert {r.decoded for r in encoded.where("doc_id = 9").collect()} == {"x" * 50_000}
    for empty in (toxicity.score(none, model), quality.score(none, forest), language_id.identify(none, {}), pii.extract(none), sentencepiece_bpe.encode(none, MODEL)):
        assert empty.count() == 0
    assert language_id.train_dictionaries(language_id.training_rows(none)) == {}
    assert training_sample(none, spark.createDataFrame([], "doc_id bigint, toxic int"), "toxic") == ([], [])
    assert 0 < toxicity.Scorer(*toxicity.train([], []).log_odds()).score("x") < 1
    assert odd.where(F.col("row") == "clash").count() == n
