from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from curatrix.operators import packs as K
from curatrix.sources.readers import front_matter_splits


def test_finite_and_unit(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(map(float, r[0])) for r in df.select(K.unit_vector("v")).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]
    assert df.select(K.finite("v")).count() == 2
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([float("nan")],)], "v array<float>").select(K.finite("v").alias("v")).collect()


def test_trace_gate(spark):
    s = ["CALLS: 2\nTOOL_SEQ: f>g\nRETURNS: ok|missing", "CALLS: 0\nTOOL_SEQ: none\nRETURNS: none", "CALLS: 1\nTOOL_SEQ: f\nRETURNS: missing", None, "CALLS: x"]
    df = spark.createDataFrame(list(enumerate(s)), "k int, s string")
    assert [r.k for r in K.trace_gate(df, "s").collect()] == [0]
    assert [r.k for r in K.trace_gate(df, "s", returns=False).orderBy("k").collect()] == [0, 2]


def test_scored_spans(spark):
    t = "<|start|>assistant<|message|>abc<|end|>"
    rows = [(t, "[[0, 3], [5, 2], [1, 999]]", 1, 2, None), (t, "bad", 1, 2, None), (t, None, 9, 2, None), (t, None, None, None, "other")]
    df = spark.createDataFrame(rows, "text string, assistant_spans_json string, completion_start_char int, completion_end_char int, loss_mode string")
    got = [[(s.start, s.stop) for s in r[0]] for r in df.select(K.scored_spans(df)).collect()]
    assert got == [[(0, 3)], [(1, 2)], [(29, 32)], []]


def test_block_dialects(spark):
    df = spark.createDataFrame([(i, 5) for i in range(5)], "k int, n int")  # thirty tokens with end tokens
    count = lambda **kw: K.blocks(df, "n", 8, "k", **kw).select("block").distinct().count()
    assert count() == 3 and count(dialect="parity") == 3 and count(dialect="profiler") == 4 and count(count=2) == 2
    assert K.blocks(df, "n", 8, "k").agg(F.sum("length")).first()[0] == 24
    assert K.blocks(df, "n", 8, "k", dialect="profiler", row_most=2).agg(F.sum("length")).first()[0] == 15
    with pytest.raises(ValueError):
        count(count=4)


def test_runs(spark, tmp_path):
    run = lambda m, p: {"meta": {"model_id": m}, "packs": [{"pack": "u", "seq": {"1024": {"model": {"ppl": p, "cc_rate": 0.1, "mean_prob": 0.5}}}}]}
    for name, r in (("a", run("x", 1.0)), ("b", run("x", 2.0)), ("c", run("y", 3.0))):
        (tmp_path / f"{name}.json").write_text(json.dumps(r))
    got = K.read_runs(spark, *[str(tmp_path / f"{n}.json") for n in "abc"]).orderBy("model_id").collect()
    assert [(r.model_id, r.seq_len, r.ppl) for r in got] == [("x", 1024, 1.0), ("y", 1024, 3.0)]


def test_heads(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    assert K.head_matching(df, F.col("k") > 40, 3, "k").count() == 3
    with pytest.raises(ValueError):
        K.head_matching(df, F.col("k") > 48, 3, "k")
    got = {r.k for r in K.head_and_sample(df, 5, 5, "k").collect()}
    assert len(got) == 10 and {0, 1, 2, 3, 4} <= got


def test_stratum_quotas():
    q = K.stratum_quotas(10, {"high": 0.4, "low": 0.6, "unknown": 0.0}, {("high", "a"): 1, ("low", "a"): 20, ("low", "b"): 20, ("unknown", "a"): 9})
    assert sum(q.values()) == 10 and q[("high", "a")] == 1 and q[("unknown", "a")] == 0


def test_card_round_trip():
    assert front_matter_splits(K.card("n", {"train": "data/train/*"}, {"train": 3})) == {"train": "data/train/*"}
