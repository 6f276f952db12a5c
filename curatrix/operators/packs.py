"""Training packs: spans to score, blocks in three dialects, run files, gates on traces, heads of data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.functions.text import strip, trace_field
from curatrix.operators.curation import block_pieces
from curatrix.operators.grammar import spans


def finite(vec: str) -> Column:
    """The vector, if all its values are finite; else an error when the result is computed."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("vector with a value that isn't finite"))).otherwise(F.col(vec))


def unit_vector(vec: str, eps: float = 1e-12) -> Column:
    """The vector over its length, or over ``eps`` if that is greater."""
    n = F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x / F.greatest(n, F.lit(eps)))


def trace_gate(df: DataFrame, sketch: str, min_calls: int = 1, none_ok: bool = False, returns: bool = True) -> DataFrame:
    """Rows whose trace sketch has enough calls, a tool sequence and, with ``returns``, a return that isn't missing."""
    calls = F.coalesce(F.try_to_number(trace_field(sketch, "CALLS"), F.lit("9999999")).cast("int"), F.lit(0))
    sequence = F.coalesce(trace_field(sketch, "TOOL_SEQ"), F.lit("none"))
    out = df.where(calls >= min_calls)
    if not none_ok:
        out = out.where(sequence != "none")
    if returns:
        out = out.where(~F.forall(F.split(F.coalesce(trace_field(sketch, "RETURNS"), F.lit("missing")), r"\|"), lambda x: strip(x) == "missing"))
    return out


def scored_spans(df: DataFrame, text: str = "text") -> Column:
    """array<struct<start, stop>> to score: those of ``assistant_spans_json`` if there are valid ones, else the completion's, else the assistant's contents."""
    n = F.length(text)
    pair = "array<struct<start:int,stop:int>>"
    none = F.array().cast(pair)
    first = F.lit(None).cast(pair)
    if "assistant_spans_json" in df.columns:
        raw = F.from_json("assistant_spans_json", "array<array<int>>")
        ok = F.filter(raw, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) >= 0) & (F.get(p, F.lit(0)) < F.get(p, F.lit(1))) & (F.get(p, F.lit(1)) <= n))
        first = F.transform(ok, lambda p: F.struct(F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("stop")))
        first = F.when(F.size(first) > 0, first)
    second = F.lit(None).cast(pair)
    if {"completion_start_char", "completion_end_char"} <= set(df.columns):
        a, b = F.col("completion_start_char").cast("int"), F.col("completion_end_char").cast("int")
        second = F.when((a >= 0) & (a < b) & (b <= n), F.array(F.struct(a.alias("start"), b.alias("stop"))))
    third = spans(text)
    if "loss_mode" in df.columns:
        third = F.when(F.col("loss_mode").isNull() | (F.col("loss_mode") == "assistant_all"), third)
    return F.coalesce(first, second, third, none)


def blocks(df: DataFrame, tokens: str, seq_len: int, *order: str, dialect: str = "collector", count: int | None = None, row_most: int | None = None) -> DataFrame:
    """The pieces of rows in token blocks, with ``scored_from``: the place in the block from which tokens may count.

    ``collector`` and ``parity``: blocks of ``seq_len`` (plus one) tokens, the first of which never counts, a short
    last block is dropped; ``profiler``: rows are cut at ``row_most``, all places count, the short block stays. With
    ``count`` exactly so many blocks come out, or an error if there are fewer.
    """
    if dialect not in ("collector", "parity", "profiler"):
        raise ValueError(f"no such dialect: {dialect}")
    n = seq_len + (dialect == "parity")
    rows = df.withColumn(tokens, F.least(F.col(tokens), F.lit(min(row_most or n, n)))) if dialect == "profiler" else df
    out = block_pieces(rows, tokens, n, *order)
    if dialect != "profiler":
        full = out.groupBy("block").agg(F.sum("length").alias("__n")).where(F.col("__n") == n).select("block")
        out = out.join(full, "block", "left_semi")
    if count is not None:
        have = out.select("block").distinct().count()
        if have < count:
            raise ValueError(f"{have} blocks of {n} tokens, {count} wanted")
        out = out.where(F.col("block") < count)
    return out.withColumn("scored_from", F.lit(0 if dialect == "profiler" else 1))


def read_runs(spark: SparkSession, *paths: str, same: bool = False) -> DataFrame:
    """(model_id, pack, seq_len, ppl, cc_rate, mean_prob) of run files; of repeated (model, pack, seq_len) the first file counts.

    With ``same``, the files must be of one model and agree in the numbers of top tokens, where both name them.
    """
    kind = "meta struct<model_id:string, model_path:string, top_k:int, entropy_topk:int>, packs array<struct<pack:string, seq:map<string, struct<model:struct<ppl:double,cc_rate:double,mean_prob:double>>>>>"
    out = None
    for i, p in enumerate(paths):
        r = spark.read.schema(kind).option("multiLine", "true").json(p).withColumn("file", F.lit(i))
        out = r if out is None else out.unionByName(r)
    if same:
        facts = ("model_id", "model_path", "top_k", "entropy_topk")
        counts = out.agg(*[F.count_distinct(F.nullif(F.col(f"meta.{f}").cast("string"), F.lit(""))).alias(f) for f in facts]).first()
        if odd := [f for f in facts if counts[f] > 1]:
            raise ValueError(f"runs differ in {', '.join(odd)}")
    flat = out.select("file", "meta.model_id", F.explode("packs").alias("p")).select("file", "model_id", "p.pack", F.explode("p.seq").alias("seq_len", "m")).select("file", "model_id", "pack", F.col("seq_len").cast("int").alias("seq_len"), "m.model.*")
    w = Window.partitionBy("model_id", "pack", "seq_len").orderBy("file")
    return flat.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "file")


def head_matching(df: DataFrame, test: Column, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows that pass the test; an error if there are fewer."""
    out = df.where(test).orderBy(*order).limit(n)
    if out.count() < n:
        raise ValueError(f"fewer than {n} rows match")
    return out


def head_and_sample(df: DataFrame, head: int, more: int, key: str, seed: int = 0) -> DataFrame:
    """The first ``head`` rows by key, and ``more`` of the others by hash."""
    first = df.orderBy(key).limit(head)
    rest = df.join(first.select(key), key, "left_anti").orderBy(F.xxhash64(key, F.lit(seed)), key).limit(more)
    return first.unionByName(rest)


def stratum_quotas(total: int, weights: dict[str, float], supply: dict[tuple[str, str], int]) -> dict[tuple[str, str], int]:
    """Places for each (difficulty, stratum): difficulties by weight, strata of one in proportion to their supply, what is short filled round and round."""
    from curatrix.operators.selection import largest_remainder

    used = {d: w for d, w in weights.items() if w > 0 and any(k[0] == d for k in supply)}
    out = dict.fromkeys(supply, 0)
    for d, n in largest_remainder(total, used).items():
        mine = {k: v for k, v in supply.items() if k[0] == d}
        for k, q in zip(sorted(mine), largest_remainder(n, {str(i): float(mine[k]) for i, k in enumerate(sorted(mine))}).values()):
            out[k] = min(q, supply[k])
    lack = min(total, sum(v for k, v in supply.items() if k[0] in used)) - sum(out.values())
    while lack > 0:
        for k in sorted(k for k in supply if k[0] in used and out[k] < supply[k]):
            if lack > 0:
                out[k], lack = out[k] + 1, lack - 1
    return out


def card(name: str, splits: dict[str, str], rows: dict[str, int]) -> str:
    """A dataset card with the splits in its front matter."""
    files = "".join(f"  - split: {s}\n    path: {p}\n" for s, p in sorted(splits.items()))
    table = "".join(f"| {s} | {n} |\n" for s, n in sorted(rows.items()))
    return f"---\nconfigs:\n- config_name: default\n  data_files:\n{files}---\n\n# {name}\n\n| split | rows |\n|---|---|\n{table}"
