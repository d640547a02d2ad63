"""Each stage of the pipeline on what the one before kept, against plain versions."""

import collections
import re

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from innsight.llm import common, language_id, mixing
from tests.llm.test_set_operators import plain_components


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_return_documents(steps):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_language_stage_rejects_what_the_classifier_rejects(spark, steps):
    docs, kept = steps[0], steps[1]
    classifier = language_id.Classifier(language_id.train_dictionaries(language_id.training_rows(docs)))
    want = set()
    for r in docs.collect():
        lang, _, margin = classifier.decide(r.text)
        if lang != language_id.UNDETERMINED and margin >= language_id.MIN_MARGIN:
            want.add(r.doc_id)
    assert set(ids(kept)) == want and len(want) > 0.95 * docs.count()


def test_exact_stage_keeps_the_least_of_equal_texts(steps):
    least = {}
    for r in steps[1].collect():
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[text] = min(r.doc_id, least.get(text, r.doc_id))
    assert set(ids(steps[2])) == set(least.values())


def test_near_stage_keeps_one_of_each_component(steps):
    found = plain_components([(r.doc_id, r.text) for r in steps[2].collect()])
    assert set(ids(steps[3])) == {component for _, _, component in found}


def test_mix_stage_comes_near_its_targets(steps):
    size = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in steps[3].collect()}
    taken = ids(steps[4])
    assert set(taken) <= set(size) and max(taken.values()) <= 3
    total, mixed = sum(n for _, n in size.values()), sum(size[i][1] * k for i, k in taken.items())
    assert mixed <= total and total - mixed <= 3 * max(n for _, n in size.values())


def test_encoding_stage_equals_the_library(steps):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in steps[4].collect()}
    rows = steps[5].collect()
    assert collections.Counter(r.doc_id for r in rows) == ids(steps[4])
    assert all(list(r.ids) == lib.encode(texts[r.doc_id], add_eos=True) for r in rows)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_take_odd_and_empty_tables(spark, odd, none, tmp_path, stage):
    path = str(tmp_path / "docs")
    odd.withColumn("a.b", F.lit(1)).withColumn("document", F.col("source")).unionByName(
        odd.where("doc_id IS NULL").withColumn("a.b", F.lit(1)).withColumn("document", F.col("source"))).write.parquet(path)
    docs = spark.read.parquet(path)
    out = stage(spark, docs, None)
    assert out.schema.names == docs.schema.names
    rows, kept = collections.Counter(map(tuple, docs.collect())), collections.Counter(map(tuple, out.collect()))
    assert kept and set(kept) <= set(rows)
    if stage is not corpus_pipeline.mix_sources:
        assert not kept - rows
    if stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        texts = collections.Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in kept.elements())
        blank = {t for t in texts if not t.strip(" ")}
        assert all(n == 1 for t, n in texts.items() if stage is corpus_pipeline.drop_copies or t not in blank)
    empty = stage(spark, none, None)
    assert empty.columns == none.columns and empty.count() == 0


def test_mix_stage_takes_what_the_mix_takes(spark, steps):
    want = collections.Counter(r.doc_id for r in mixing.mix(steps[3]).select("doc_id").collect())
    assert ids(steps[4]) == want


def test_run_leaves_only_its_result(spark, small, tmp_path, monkeypatch):
    for module in (corpus_pipeline, common):
        monkeypatch.setattr(module, "shared_folder", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, small).count() > 0
    assert [p.name.split("-")[:2] for p in tmp_path.iterdir()] == [["pipeline", "sentencepiece"]]
