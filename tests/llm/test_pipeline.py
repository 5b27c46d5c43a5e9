"""The pipeline's stages and its run."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from tests.llm.test_operators import base_spans, brute_classes, clashing
from weftgraph.llm import langid, mixing

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 34 --", "en", "src0", 8), (10**6 + 1, None, None, None, None)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs.union(extra), SF)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    single = stages["near_duplicates"](spark, docs, SF)
    classes = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    clean = stages["private_data"](spark, docs, SF).collect()
    assert not any(base_spans(r.text) for r in clean) and all(r.n_chars == len(r.text) for r in clean)
    mixed = stages["mix"](spark, docs, SF).collect()
    assert len({r.doc_id for r in mixed}) < len(mixed)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def stage(name, spark, df):
    return dict(corpus_pipeline.STAGES)[name](spark, df, SF)


def test_language_stage_equals_the_tagger(spark, docs):
    rows = docs.collect()
    model = langid.train([(langid.word_runs(r.text), r.lang) for r in rows if r.lang])
    odd = [(10**6 + k, t, None, "s", 1) for k, t in enumerate(["qzxj wvkq jxqz kqvz", "山川日本人大 " * 9, "12", "", None, "Привет как дела сегодня", "Żółć gęślą jaźń źdźbło"])]
    kept = {r.doc_id for r in stage("language", spark, docs.union(spark.createDataFrame(odd, docs.schema))).collect()}
    want = {r.doc_id for r, (lang, _, known) in zip(rows, model.documents([r.text for r in rows]), strict=True) if lang != "und" and known >= corpus_pipeline.LEAST_KNOWN}
    assert kept == want == {r.doc_id for r in rows}


def test_mix_stage_equals_brute_force(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    words = {r.doc_id: re.findall(r"[^ \t-\r]+", r.text or "") for r in rows}
    _, places = mixing.brute_force([(r.doc_id, r.source, len(words[r.doc_id])) for r in rows])
    draws, want = {}, []
    for key in places.values():
        draws[key] = draws.get(key, 0) + 1
    for source in {r.source for r in rows}:
        at = 0
        for r in rows:
            if r.source == source:
                times = [draws.get((source, (at + k) // mixing.BLOCK), 0) for k in range(len(words[r.doc_id]))]
                want += [(r.doc_id, tuple(w for w, n in zip(words[r.doc_id], times, strict=True) if n >= k)) for k in range(1, max(times, default=0) + 1)]
                at += len(words[r.doc_id])
    got = [(r.doc_id, tuple(re.findall(r"[^ \t-\r]+", r.text))) for r in stage("mix", spark, docs).collect()]
    assert sorted(got) == sorted(want)


def test_encode_stage_equals_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in stage("encode", spark, docs).collect():
        assert list(memoryview(bytes(r.ids)).cast("I")) == known.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) // 4


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, docs, name):
    wide = clashing(docs.limit(20).unionAll(docs.limit(20)).unionAll(spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0)], docs.schema)))
    done = stage(name, spark, wide)
    if name == "encode":
        assert done.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and done.count() == 42
    else:
        assert done.columns == wide.columns and done.schema == wide.schema
        assert all(r.score == r.spans == r.taken == 7 for r in done.collect())
    assert stage(name, spark, wide.limit(0)).collect() == []


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_no_stage_swallows_imports():
    text = open(corpus_pipeline.__file__, encoding="utf-8").read()
    assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", text)
