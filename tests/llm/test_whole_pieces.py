"""Segments around the lattice's longest: they must neither fail nor differ from the library's."""

import os

import pytest

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")
def test_segments_of_60_to_64_characters(make):
    from sluice.llm.sentencepiece_lattice import Vocabulary, encode

    vocabulary = Vocabulary.load(MODEL)
    texts = [f"a{t}b" for n in range(58, 65) for t in ("\n" + "-" * n + "\n", "=" * n, " " + "ab" * (n // 2) + "c" * (n % 2), " " * n)] + ["=" * n for n in range(60, 65)]
    got = {x["doc_id"]: x for x in encode(make(texts), vocabulary).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["ids"] == vocabulary.library.encode(t) and got[i]["round_trip"], repr(t)


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")
def test_slices_are_shuffled_once(spark, make):
    from sluice.llm.sentencepiece_lattice import Vocabulary, encode

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 97)  # more than the slices are dealt to
    try:
        plan = encode(make(["some words", "and some more"]), Vocabulary.load(MODEL))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "hashpartitioning(slice" in plan and "97), REPARTITION_BY_NUM" not in plan
