"""SimHash at a wide radius, and the pipeline's near-duplicate stage, against brute-force Jaccard likeness."""

import random

import pytest
from plain_jaccard import plain_components

import corpus_pipeline
from cohortloom.llm import simhash_texts


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    licence = [f"licence{i}" for i in range(30)]
    made = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(5, 120)) + (licence if rng.random() < 0.4 else [])
        made.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            base = list(base)
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            made.append(" ".join(base))
    return [*made, "", None, " \n", "one two", "One  two", "one two three", made[0].upper()]


@pytest.mark.parametrize("bucket", [4, 4096])
def test_links_are_all_pairs_of_enough_likeness(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash_texts, "COMMON_IN", 2)
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    found = {r.doc_id: r.component_id for r in simhash_texts.near_texts(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
    want = dict(zip([k for k, _ in rows], plain_components(rows)))
    assert found == want
    assert len(set(want.values())) < len(rows) - 50


def test_stage_keeps_one_of_each_component(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted(set(plain_components(rows)))


def test_null_ids_link(spark):
    a = [f"a{i}" for i in range(60)]
    change = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(a))
    # 1 and 2 are too far from each other and both near the row without an id.
    rows = [(1, change(0, 1)), (None, change(0, 1, 58, 59)), (2, change(58, 59, 2, 3, 4, 5, 0, 1))]
    want = plain_components(rows)
    got = simhash_texts.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.component_id for r in got) == sorted(want)
