"""The pipeline's stages: what each keeps, and the whole run."""

import corpus_pipeline
from tests.llm.test_operators import components, contamination, docs, pairs


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "source_mixing", "sharding"]
    frames = [docs]
    for _, apply in corpus_pipeline.STAGES:
        frames.append(apply(spark, frames[-1], sf).cache())
    assert all(f.columns == docs.columns for f in frames[:-1])
    good, single, clean = frames[1:4]
    assert sorted(i for i, _ in pairs(single)) == sorted(r[0] for r in components(pairs(good)) if r[3])
    assert sorted(i for i, _ in pairs(clean)) == sorted(r[0] for r in contamination(pairs(single), items) if not r[-1])
    assert {i for i, _ in pairs(frames[4])} <= {i for i, _ in pairs(clean)}
    assert frames[5].count() == frames[4].count() and set(frames[5].columns) > set(docs.columns)
    assert sorted(frames[5].columns[-3:]) == ["shard", "slot", "virtual_slot"]


def test_awkward_rows_and_empty_tables(spark, sf):
    for df in (docs(spark), docs(spark).limit(0)):
        for name, apply in corpus_pipeline.STAGES:
            out = apply(spark, df, sf)
            assert out.columns[: len(df.columns)] == df.columns, name
            assert out.count() <= 2 * df.count()
