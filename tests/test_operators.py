"""Hand-computed cases of the core operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import text as X
from curatrix.operators import curation as C
from curatrix.operators import grammar as H
from curatrix.operators import normalize as N
from curatrix.operators import scoring as S
from curatrix.operators import selection as L
from curatrix.operators import tools as T

FINAL = "<|start|>assistant<|channel|>final<|message|>"


def flags(spark, *texts):
    q = H.quality_flags("t")
    return spark.createDataFrame([(t,) for t in texts], "t string").select(*[c.alias(n) for n, c in q.items()]).collect()


def test_grammar_flags(spark):
    rows = flags(spark, "hello", "<|start|>user<|message|>hi", FINAL + "x" * 32 + "<|return|>", FINAL + "x" * 31 + "<|return|>", "<|start|>user<|message|>a<|call|>")
    assert [r.valid for r in rows] == [True, False, True, True, True]
    assert [r.completion_nonempty for r in rows] == [False, False, True, False, False]
    assert [r.has_tool for r in rows] == [False, False, False, False, True]
    assert [r.message_count for r in rows] == [0, 0, 1, 1, 1]


def test_grammar_headers(spark):
    t = "junk<|start|>a<|end|>b<|message|>c<|end|>junk<|start|>assistant<|channel|>x<|channel|>y<|message|>d<|return|>"
    got = spark.createDataFrame([(t,)], "t string").select(H.messages("t").alias("m")).first().m
    assert [(m.role, m.channel, m.content, m.end_tag) for m in got] == [("a<|end|>b", None, "c", "<|end|>"), ("assistant", "x<|channel|>y", "d", "<|return|>")]


def test_removal_makes_no_tag(spark):
    inner = "<|start|>u<|message|>x<|end|>"
    assert flags(spark, "<|sta" + inner + "rt|>")[0].valid


def plain_spans(t):
    out, pos = [], 0
    while (s := t.find("<|start|>", pos)) >= 0:
        m = t.find("<|message|>", s)
        ends = [(t.find(d, m + 11), d) for d in ("<|end|>", "<|call|>", "<|return|>") if m >= 0 and t.find(d, m + 11) >= 0]
        if m < 0 or not ends:
            return []
        at, d = min(ends)
        role = t[s + 9 : m].split("<|channel|>")[0]
        if role == "assistant" or role.startswith("assistant "):
            out.append((m + 11, at))
        pos = at + len(d)
    return out


def test_spans_against_plain_python(spark):
    rng = random.Random(1)
    parts = ["<|start|>", "<|message|>", "<|end|>", "<|call|>", "<|return|>", "<|channel|>", "assistant", "user", "x\U0001f600", " ", "\n", "assistant to=f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 16))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.spans("t").alias("s")).collect()
    for r in rows:
        assert [(s.start, s.stop) for s in r.s] == plain_spans(r.t), r.t


def test_render_keeps_own_end(spark):
    t = "<|start|>user<|message|>a<|end|><|start|>assistant<|channel|>final<|message|>b<|call|>"
    assert spark.createDataFrame([(t,)], "t string").select(H.render(H.messages("t")).alias("r")).first().r == t


def test_scalars(spark):
    df = spark.createDataFrame([("  a  b\t",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.strip("t")).collect()] == ["a  b", "", None]
    assert [r[0] for r in df.select(X.word_count("t")).collect()][:2] == [2, 0]
    assert [r[0] for r in df.select(X.unknown("t")).collect()] == ["a  b", "unknown", "unknown"]
    n = spark.createDataFrame([(0,), (127,), (128,), (512,), (None,)], "n int")
    assert [r[0] for r in n.select(X.length_label("n", (0, 128, 256, 512))).collect()] == ["len_00000_00128", "len_00000_00128", "len_00128_00256", "len_00512_inf", "len_00000_00128"]
    ids = spark.createDataFrame([(" AB ",), ("ab",), (" ",)], "id string").select(X.hash_head("id")).collect()
    assert ids[0] == ids[1] and ids[2][0] == 0


def test_pools_of_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, 0.875), (2, 0.25), (3, 0.5), (4, None), (5, float("nan"))], "id int, meta_correctness double")
    got = {(r.id, r.pool) for r in C.pools(df).collect()}
    assert got == {(1, "has_correctness_meta"), (1, "high_correctness"), (2, "has_correctness_meta"), (2, "low_correctness"), (3, "has_correctness_meta"), (3, "mid_correctness"), (4, "missing_correctness_meta"), (5, "has_correctness_meta")}
    assert {r.pool for r in C.pools(df.select("id")).collect()} == {"missing_correctness_meta"}


def test_base_quality_nulls(spark):
    df = spark.createDataFrame([(True,), (None,), (False,)], "quality_valid_harmony boolean")
    assert df.where(C.base_quality(df)).count() == 1


def test_attach_group(spark):
    df = spark.createDataFrame([("A ",), ("b",), (None,)], "id string")
    m = spark.createDataFrame([("a", " Tool"), ("b", None), (None, "x")], "id string, mix_group string")
    assert [(r.id, r.mix_group) for r in C.attach_group(df, m).collect()] == [("A ", "tool")]
    with pytest.raises(Exception, match="id without a group"):
        C.attach_group(df, m, on_missing="fail").collect()


def test_offsets_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "k int, n int")
    for parts in (1, 7):
        got = [r.offset for r in C.running_offsets(df.repartition(5), "n", "k", parts=parts).orderBy("k").collect()]
        assert got == [sum(j % 7 for j in range(i)) for i in range(200)]


def test_strided(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    assert sorted(r.k for r in C.strided(df, 10, "k").collect()) == [i * 103 // 10 for i in range(10)]


def test_allocation():
    assert L.largest_remainder(10, {"tool": 0.4, "reasoning": 0.4, "general": 0.2}) == {"tool": 4, "reasoning": 4, "general": 2}
    assert L.largest_remainder(11, {"tool": 0.4, "reasoning": 0.4, "general": 0.2}) == {"tool": 4, "reasoning": 5, "general": 2}
    assert L.largest_remainder(0, {"a": 1.0}) == {"a": 0}
    assert L.borrow({"math": 5, "proof": 5}, {"math": 9, "proof": 2}) == {"math": 8, "proof": 2}


def test_donors():
    assert L.donate({"a": 5, "b": 5, "c": 1}, {"a": 2, "b": 9, "c": 9}) == {"a": 2, "b": 5, "c": 4} and L.donate({"a": 1}, {"a": 1}) == {"a": 1}
    with pytest.raises(ValueError, match="3 more"):
        L.donate({"a": 5}, {"a": 2})


def test_files_and_kinds():
    from curatrix.sources import readers as R

    assert R.files_of_shard(["c", "a", "b", "d", "e"], 1, 2) == ["b", "d"] and R.one_kind(["x.jsonl", "y.jsonl.gz"]) == ["x.jsonl", "y.jsonl.gz"]
    with pytest.raises(ValueError, match="different kinds"):
        R.one_kind(["x.jsonl", "y.parquet"])


def test_lsh_keys(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "id int, e array<float>")
    planes = np.random.default_rng(0).standard_normal((8, 5)).astype(np.float32)
    want = {i: int(((v @ planes) > 0) @ (1 << np.arange(5))) for i, v in enumerate(x)} | {98: None, 99: None}
    assert {r.id: r.bucket_key for r in L.lsh_keys(df, "e", 8, 5).collect()} == want


def test_capped_pick(spark):
    rows = [(b, g, 10 - b, b * 10 + j) for b in range(8) for j, g in enumerate("ab")]
    df = spark.createDataFrame([(b, g, c, float(s), s) for b, g, c, s in rows], "b int, g string, c int, s double, id int")
    got = L.capped_pick(df, 4, "g", "b", "c", "s", "id", fraction=0.5).collect()
    assert len({r.b for r in got}) == 4 and sorted(r.g for r in got) == ["a", "a", "b", "b"]


def plain_walk(rows, k, fraction):
    """The two walks one row after the other: rows are (bucket, group, count, score, id)."""
    cap, used, seen, out = max(1, int(fraction * k)), {}, set(), []
    fill = {b: max(r[2] for r in rows if r[0] == b) for b, *_ in rows}
    for limit in (cap, k):
        for b in sorted(fill, key=lambda b: (-fill[b], b)):
            for r in sorted((r for r in rows if r[0] == b), key=lambda r: (-r[3], r[4])):
                if b not in seen and len(out) < k and used.get(r[1], 0) < limit:
                    seen.add(b), out.append(r[4])
                    used[r[1]] = used.get(r[1], 0) + 1
    return sorted(out)


@pytest.mark.parametrize("groups,k,fraction", [("a", 9, 0.35), ("aaaaaab", 12, 0.35), ("abc", 10, 0.2), ("abcdefgh", 40, 0.5), ("aabN", 7, 0.35)])
def test_capped_pick_is_the_walk(spark, groups, k, fraction):
    rng = random.Random(k)
    rows = [(rng.randrange(30), g if (g := rng.choice(groups)) != "N" else None, rng.randrange(4), float(rng.randrange(6)), i) for i in range(150)]
    df = spark.createDataFrame(rows, "b int, g string, c int, s double, id int")
    assert sorted(r.id for r in L.capped_pick(df, k, "g", "b", "c", "s", "id", fraction).collect()) == plain_walk(rows, k, fraction)
    assert L.capped_pick(df.limit(0), k, "g", "b", "c", "s", "id", fraction).count() == 0


def test_backfill_takes_sequences_first(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaaabbcdef")) for i in range(60)]
    got = {r.i: r.phase for r in L.sequence_backfill(spark.createDataFrame(rows, "i int, s string"), 12, "s", "i", 3, 4).collect()}
    first = {}
    for i, q in rows:
        first.setdefault(q, i)
    ahead = sorted(first.values())[:4]
    assert sorted(i for i, p in got.items() if p == 1) == ahead
    count, rest = {dict(rows)[i]: 1 for i in ahead}, []
    for i, q in rows:  # the second walk
        if i not in ahead and count.get(q, 0) < 3 and len(rest) < 8:
            rest.append(i)
            count[q] = count.get(q, 0) + 1
    assert sorted(i for i, p in got.items() if p == 2) == rest


def test_keys_ids_and_lengths(spark):
    df = spark.createDataFrame([(3, 5, "a", [1, 2]), (None, 1, "b", None)], "s long, k long, id string, input_ids array<int>")
    assert [r[0] for r in df.select(L.composite_key("s", "k", 4)).collect()] == [3 * 16 + 5, None]
    with pytest.raises(Exception, match="beyond 63 bits"):
        df.select(L.composite_key("s", "k", 2)).collect()
    assert [r[0] for r in df.select(C.token_length(df)).collect()] == [2, None]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert C.require_all_ids(df, ids("a", "a", None)).count() == 1
    with pytest.raises(ValueError, match="2 ids, 1 rows"):
        C.require_all_ids(df, ids("a", "z"))
    best = spark.createDataFrame([("x", "d", 1.0), ("y", "d", 1.0), ("z", "d", float("nan")), ("x", "e", None)], "id string, domain string, score double")
    got = {r.domain: r.id for r in L.best_of_each(best, ("domain",), "score", seed=7).collect()}
    import zlib

    assert got == {"d": min("xy", key=lambda i: zlib.crc32(f"7:{i}".encode()) & 0x7FFFFFFF), "e": "x"}
    sizes = spark.createDataFrame([(0,), (None,), (1023,), (1024,), (7296,), (1 << 61,)], "n long")
    assert [r[0] for r in sizes.select(X.human_bytes("n")).collect()] == ["n/a", "n/a", "1023.00 B", "1.00 KB", "7.12 KB", "2048.00 PB"]


def test_quantiles_without_gathering(spark):
    from curatrix.operators import profile as P

    rng = np.random.default_rng(6)
    rows = [("ab"[int(k)], float(v)) for k, v in zip(rng.random(500) < 0.3, np.round(rng.random(500), 2))] + [("c", None), (None, 4.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.lo, r.mid) for r in P.quantiles(df, "v", {"lo": 0.15, "mid": 0.5}, "g").collect()}
    for g in ("a", "b", None):
        x = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx((np.quantile(x, 0.15), np.quantile(x, 0.5)))
    clash = df.selectExpr("g as value", "g as n", "v as before", "g as all", "1 as offset")
    assert {(r.value, r.n): r.m for r in P.quantiles(clash, "before", {"m": 0.5}, "value", "n").collect()} == {(g, g): pytest.approx(m) for g, (_, m) in got.items()}
    assert "c" not in got and P.quantiles(df.limit(0), "v", {"m": 0.5}).count() == 0
    by = {r.g: r for r in P.numeric_summary(df, "v", "g").collect()}
    assert (by[None].n, by[None].median, by[None].p95) == (2, 4.5, 5.0) and (by["c"].n, by["c"].median, by["c"].p95) == (0, None, None)
    one = P.numeric_summary(df, "v").first()
    assert (one.n, one.most) == (502, 5.0) and one.median == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_verdicts(spark):
    d = spark.createDataFrame([(f"p{i}", 1, 0.0, 0.0, 0.0, 0.0) for i in range(9)] + [("bad", 1, 2.0, 0.3, -0.2, 0.4)], "pack string, seq_len int, d_ppl double, d_cc double, d_p double, js double")
    assert {r.pack: r.verdict for r in S.verdicts(S.degradation(d)).collect()} == {f"p{i}": "mixed" for i in range(9)} | {"bad": "worse"}


def test_scores(spark):
    t = spark.createDataFrame([("a", -1.0), ("a", float("-inf")), ("b", float("nan")), ("c", -100.0)], "k string, logprob double")
    got = {r.k: r for r in S.perplexity(t, ("k",)).collect()}
    assert got["a"].tokens == 1 and abs(got["a"].ppl - math.e) < 1e-9
    assert got["b"].tokens == 0 and math.isnan(got["b"].ppl)
    assert got["c"].ppl == pytest.approx(math.exp(30))


def test_divergence(spark):
    h = lambda *n: spark.createDataFrame([("k", i, x) for i, x in enumerate(n) if x], "k string, bin int, n long")
    js = lambda a, b, d="skip": S.js_divergence(a, b, ("k",), ("bin",), d).first().js
    assert js(h(1, 2), h(1, 2)) == 0
    assert js(h(1, 0), h(0, 1)) == pytest.approx(math.log(2))
    for d in ("clip", "clip_mean", "add"):
        assert js(h(1, 0), h(0, 1), d) == pytest.approx(math.log(2), abs=1e-6)


def test_gate_rules(spark):
    run = lambda p: spark.createDataFrame([("u", 1024, p, 0.1, 0.5)], "pack string, seq_len int, ppl double, cc_rate double, mean_prob double")
    js = spark.createDataFrame([("u", 1024, 0.0)], "pack string, seq_len int, js double")
    assert not S.gate(run(4.0), run(4.24), js).first().accepted
    assert S.gate(run(4.0), run(4.24), js, ppl_rule="either").first().accepted


def test_accepted_prefix(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([2], [1]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(S.accepted_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 0]


def tagged(*messages):
    return "".join(f"<|start|>{h}<|message|>{c}<|{e}|>" for h, c, e in messages)


def test_behaviour_signature():
    t = tagged(("assistant<|channel|>analysis", " look it\n up ", "end"), ("assistant to=f<|channel|>commentary", '{"name": "g", "arguments": {"b": 1, "a": 2}}', "call"), ("g<|channel|>commentary", '{"x": "Error"}', "end"), ("assistant<|channel|>final", "According to the tool: 7", "return"))
    assert T.behaviour(t).splitlines() == ["TOOL_SEQ: g", "CALLS: 1", "ARGS: g[a,b]", "RETURNS: error", "RET_KEYS: x", "RET_ROLES: g", "USED_TOOL_OUTPUT: yes", "ANSWER_TYPE: text", "PLAN_EXCERPT: look it up"]
    # tools that speak without a call stand for calls; the plan falls back to what the assistant says
    t = tagged(("tool", '{"b":1,"a":2}', "end"), ("assistant<|channel|>final", " 7 ", "return"))
    assert T.behaviour(t).splitlines()[:2] == ["TOOL_SEQ: tool[a,b]", "CALLS: 1"] and T.behaviour(t).splitlines()[-2:] == ["ANSWER_TYPE: numeric", "PLAN_EXCERPT: 7"]
    # two calls and one output: the second return is missing; an output before any call is none
    t = tagged(("x", "early", "end"), ("assistant to=f", '{"q": 1}', "call"), ("assistant to=h", "plain", "call"), ("tool", "[]", "end"), ("tool", "late", "end"))
    assert T.behaviour(t).splitlines()[:6] == ["TOOL_SEQ: f -> h", "CALLS: 2", "ARGS: f[q] | h[]", "RETURNS: empty | missing", "RET_KEYS: list | missing", "RET_ROLES: f | missing"]
    # a call without any name doesn't count, more payloads than the cap are cut
    many = '{"tool_calls": [' + ",".join(['{"name": "k", "arguments": "{\\"z\\": 0}"}'] * 20) + "]}"
    assert T.behaviour(tagged(("assistant", "{}", "call"))).startswith("TOOL_SEQ: none\nCALLS: 0")
    assert T.behaviour(tagged(("assistant", many, "call"))).splitlines()[1] == "CALLS: 16" and "k[z]" in T.behaviour(tagged(("assistant", many, "call")))
    assert T.behaviour("<|start|>user<|message|>open") == "" and T.behaviour(None).splitlines()[1] == "CALLS: 0"


def test_tool_payloads():
    value = {"calls": [{"tool": "a"}, "no"], "call": {"function": {"name": "b"}}, "tool_call": {"name": "c"}, "tool_name": "d"}
    assert [T.name_of(c) for c in T.calls_in(value)] == ["a", "b", "d"] and T.names_in(value) == ["d", "a", "b", "c"]
    assert T.calls_in([value, 3])[-1] is value and T.calls_in({"x": 1}) == [] and T.name_of({"name": " ", "function": {"name": "f"}}) == "f"
    assert T.argument_keys({"function": {"arguments": '{"q": 1}'}}) == ["q"] and T.argument_keys({"x": 1, "name": "n"}) == ["name", "x"] and T.argument_keys({"calls": [{"arguments": {"b": 1}}, {"a": 1}]}) == ["a", "b"]
    assert [T.return_status(x) for x in ("", "{}", "[]", "ok", '{"stderr": 1}', "Traceback")] == ["empty", "empty", "empty", "ok", "error", "error"]
    assert T.payload_ok("plain") and not T.payload_ok("{bad") and [T.answer_kind(x) for x in ("{bad", "{}", "-1.5")] == ["text", "json", "numeric"]
    rows = T.trace(tagged(("tool", '{"name": "s"}', "end"), ("lookup", "{}", "end"), ("assistant", '{"function": {"name": "f"}}', "call"), ("assistant", "text", "call")))
    assert T.output_roles(rows) == ["s", "lookup"] and T.output_keysets(rows) == ["name", "dict_empty"] and T.call_sequence(rows) == ["f"]


def test_conversation():
    call = lambda a: {"function": {"name": "stateful_python_code_exec", "arguments": a}}
    text = N.conversation([{"role": "user", "content": {"b": 1, "a": "é"}}, {"role": "assistant", "reasoning_content": "hm", "tool_calls": [call('{"code":"x"}'), call("not json"), call("")], "content": "dropped"}, {"role": "tool", "content": "1"}])
    assert text == '<|start|>user<|message|>{"a": "é", "b": 1}<|end|><|start|>assistant<|channel|>analysis<|message|>hm<|end|><|start|>assistant to=python<|channel|>analysis<|message|>x<|call|><|start|>assistant to=python<|channel|>analysis<|message|>not json<|call|><|start|>tool<|channel|>commentary<|message|>1<|return|>'


def test_conversation_roles():
    text = N.conversation([{"role": None, "content": "x"}, {"role": "assistant", "content": " "}, {"role": "assistant", "tool_calls": [{"function": {"name": "find", "arguments": '{"b": 1, "a": 2}'}}, "odd", {"function": {"arguments": {"a": 1}}}, {"function": {"arguments": "{}"}}]}, {"role": "tool", "name": " python_code_exec ", "content": None}], system="s", developer="d")
    assert text == tagged(("system", "s", "end"), ("developer", "d", "end"), ("assistant to=find<|channel|>analysis", '{"a": 2, "b": 1}', "call"), ("assistant<|channel|>analysis", "{}", "call"), ("python_code_exec<|channel|>commentary", "", "return"))
    assert N.conversation([]) == ""


def test_best_setting(spark):
    df = spark.createDataFrame([([("reason_low", 0.5), ("reason_high_no_tool", 0.9), ("reason_medium", 0.9)],), ([],)], "m array<struct<setting:string,accuracy:double>>")
    b = N.best_setting("m")
    r = df.select(*[c.alias(n) for n, c in b.items()]).collect()
    assert (r[0].meta_eval_best_setting, r[0].meta_correctness, r[0].meta_correctness_high) == ("reason_high_no_tool", 0.9, 0.9)
    assert r[1].meta_correctness is None


def test_files(spark, tmp_path):
    from curatrix.sources import readers as R
    from curatrix.sources import writers as W

    (tmp_path / "a.jsonl").write_text('{"text": "x"}\n\n{bad\n[1]\n')
    rows = R.json_lines(spark, str(tmp_path / "a.jsonl"), "text string").collect()
    assert sorted((r.text, r.bad) for r in rows if not r.bad) == [("x", False)] and sum(r.bad for r in rows) == 2
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert sorted(r.id for r in R.ids_file(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    (tmp_path / "map.tsv").write_text("# no\na\tzebra\na\ttool\nb,general\n")
    assert {r.id: r.mix_group for r in R.mapping_file(spark, str(tmp_path / "map.tsv")).collect()} == {"a": "tool", "b": "general"}
    names = spark.createDataFrame([("/x/train-00001.parquet",), ("high.part_02.jsonl",), ("low.jsonl.gz",)], "n string").select(R.split_of(F.col("n"))).collect()
    assert [r[0] for r in names] == ["train", "high_part02", "low"]
    W.shards(spark.range(25), str(tmp_path / "out"), rows=10)
    assert R.parquet_tree(spark, str(tmp_path / "out")).count() == 25

    import pyarrow as pa
    import pyarrow.parquet as pq

    half = pa.array(np.array([1.5, 2.5, 3.5, 4.5], np.float16))
    pq.write_table(pa.table({"id": ["a", "b"], "embedding": pa.FixedSizeListArray.from_arrays(half, 2)}), tmp_path / "half.parquet")
    assert {r.id: r.embedding for r in R.half_precision(spark, str(tmp_path / "half.parquet")).collect()} == {"a": [1.5, 2.5], "b": [3.5, 4.5]}


def test_stream(spark, tmp_path):
    from curatrix.streaming.ingest import pool_stream

    df = spark.sql("select 'a' id, true quality_has_tool, timestamp'2025-01-01' ingested_at union all select 'a', true, timestamp'2025-01-01'")
    df.write.parquet(str(tmp_path / "in"))
    pool_stream(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out")).awaitTermination(60)
    assert sorted(r.pool for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["missing_correctness_meta", "tool_use"]
    # a restart goes on where the last run ended
    pool_stream(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    from curatrix import session

    class Cluster:
        conf = type("N", (), {"get": lambda self, k, d=None: d})()
        sparkContext = type("C", (), {"master": "spark://m:7077", "applicationId": "x"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster)
    Cluster.sparkContext.master = "local[4]"
    assert session.shared_folder(Cluster).startswith("file:/")
    kept = session.cut_lineage(spark.range(3))
    assert kept.count() == 3
    session.drop_tables(spark)
    with pytest.raises(Exception):  # noqa: B017
        kept.count()
