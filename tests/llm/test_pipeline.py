"""The pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline
from brindle.llm import quality
from brindle.llm.common import scratch, table

LOWER = {i: i + 32 for i in range(65, 91)}
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch(stage(spark, before, DATA), name)
        assert after.columns == corpus_pipeline.COLUMNS
        if name == "quality_rules":
            assert after.count() == quality.judge(before).where("kept").count()
        if name == "simhash_near_dedup":
            # Similar pairs, counted from the texts themselves, do not both stay; what goes has a similar one.
            shingles = {}
            for r in before.collect():
                w = r.text.translate(LOWER).split()
                shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
            alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
            kept = {r.doc_id for r in after.collect()}
            pairs = [(a, b) for a in shingles for b in shingles if a < b and alike(a, b) >= 0.8]
            assert pairs and sum(not {a, b} <= kept for a, b in pairs) >= 0.9 * len(pairs)
            assert all(any(alike(a, b) >= 0.65 for b in shingles if b != a) for a in shingles if a not in kept)
        if name == "suffix_array_dedup":
            assert after.count() == before.count()
        before = after
    packed = corpus_pipeline.harmonic_packing(spark, before, DATA)
    assert packed.select("doc_id").distinct().count() == before.count()
