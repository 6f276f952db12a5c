from __future__ import annotations

import numpy as np
import pytest

from curatrix.plans import programs as G

TEXT = "<|start|>user<|message|>q{0}<|end|><|start|>assistant to=f<|message|>{{\"name\": \"f{0}\", \"arguments\": {{\"a\": 1}}}}<|call|><|start|>f<|message|>ok<|end|><|start|>assistant<|channel|>final<|message|>done<|return|>"


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(0).standard_normal((300, 16)).astype(np.float32)
    rows = [(f"i{k:03d}", "abc"[k % 3], ("tool", "reasoning", "general")[k % 3 if k % 2 else 0], k, k, ("math", "proof")[k % 2], v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id string, dataset string, mix_group string, prompt_tokens int, stats_embed_word_count int, meta_domain string, embedding array<float>")


def test_candidates(spark):
    df = spark.createDataFrame([(f"i{k}", TEXT.format(k), True) for k in range(4)] + [("x", "no tags", True), ("y", None, True)], "id string, text string, quality_has_tool boolean")
    assert {r.embed_text for r in G.make_candidates(df).collect()} == {f"q{k}" for k in range(4)}
    seen = G.make_candidates(df, "behavior", ids=spark.createDataFrame([("i1",)], "id string"), require=("quality_has_tool",)).collect()
    assert [r.id for r in seen] == ["i1"] and "ARGS: f1[a]" in seen[0].embed_text
    assert G.pack_by_length(df.selectExpr("id", "length(text) stats_tok_len")).count() == 6


def test_cover_and_pack(vectors):
    cover = G.prompt_cover(vectors, 30, 16, bits=8)
    assert cover.count() == 30 == cover.select("id").distinct().count()
    assert {r.mix_group: r["count"] for r in cover.groupBy("mix_group").count().collect()} == {"tool": 12, "reasoning": 12, "general": 6}
    assert G.prompt_pack(cover, 10).count() == 10
    with pytest.raises(ValueError):
        G.prompt_cover(vectors, 3000, 16, bits=4)


def test_bucket_and_tool_packs(spark, vectors):
    got = G.bucket_pack(vectors, 20, 16, "tool", "meta_domain", {"math": 12, "proof": 8}, bits=8)
    assert {r.meta_domain: r["count"] for r in got.groupBy("meta_domain").count().collect()} == {"math": 12, "proof": 8}
    sketch = vectors.selectExpr("id", "concat('CALLS: 1\nTOOL_SEQ: s', prompt_tokens % 5, '\nRETURNS: ok') embed_text")
    pack = G.tool_pack(vectors, sketch, 12, 16, bits=8, per_sequence=3)
    assert pack.count() == 12 and pack.select("tool_seq").distinct().count() == 5


def test_manifold(vectors):
    r = G.manifold_report(vectors, 16)
    assert 0 <= r["purity"] <= 1 and r["groups"] == 3 and r["pc1"] >= r["pc2"]
