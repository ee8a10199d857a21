import random

import corpus_pipeline

from .conftest import prose
from .test_dedup import brute_components, near_copies, shingles

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows_they_should(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < len(rows) <= docs and all(r["lossless"] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)


def test_near_dedup_stage_takes_similarity_from_80_percent(spark):
    rng = random.Random(8)
    rows = near_copies(3, bases=4, copies=20)
    for _ in range(10):  # 96 shingles each, 86 common: 86 / 106 = 0.811
        words = prose(rng, 90, 10**6).split()
        rows += [(len(rows) + k, " ".join(words + [f"o{rng.randrange(10**9)}" for _ in range(10)])) for k in range(2)]
    a, b = (shingles(t) for _, t in rows[-2:])
    assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert kept == {i for i, (_, c) in brute_components(rows, 80).items() if i == c} != {i for i, (_, c) in brute_components(rows).items() if i == c}
