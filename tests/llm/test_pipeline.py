"""The pipeline: every stage on small documents, and whole on the test tables."""

import re

import corpus_pipeline as pipeline
import __spark_entry__ as contract
import public_tokenizers
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_registered():
    names = contract.queries()
    assert "pipeline" in names
    assert {int(re.match(r"op(\d+)_", n).group(1)) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "personal_data", "packing"]


def test_stages_keep_their_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, step in pipeline.STAGES[:-1]:
        after = step(spark, before, SF).persist()
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        kept, had = {r.doc_id for r in after.collect()}, {r.doc_id for r in before.collect()}
        assert kept <= had and len(kept) == after.count()
        if name == "language":
            assert not any(not re.search(r"[^\W\d_]", r.text or "") for r in after.collect())
        if name == "near_dedup":
            assert len(kept) < len(had)
        if name == "personal_data":
            assert kept == had and after.filter(r"text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+\\.[a-z]'").count() == 0
        before = after
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    total = sum(len(encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    assert sum(r.length for r in pipeline.run(spark, SF).collect()) == total


def test_stages_on_nothing_and_on_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.filter("doc_id < 0")
    blank = spark.createDataFrame([tuple(1 if f.name == "doc_id" else None for f in docs.schema)], docs.schema)
    for _, step in pipeline.STAGES:
        assert step(spark, none, SF).count() == 0
        assert step(spark, blank, SF).count() <= 1
