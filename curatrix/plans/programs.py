"""Composite programs: the operators put together, with the defaults of the pipeline as keyword arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import strip, word_count
from curatrix.operators import curation as C
from curatrix.operators import geometry as G
from curatrix.operators import grammar as H
from curatrix.operators import packs as K
from curatrix.operators import selection as L
from curatrix.operators.tools import behaviour_udf

MIX = {"tool": 0.4, "reasoning": 0.4, "general": 0.2}


def build_pools(df: DataFrame, high: float = 0.875, low: float = 0.25) -> DataFrame:
    """Good rows with a ``pool`` column; write with ``writers.shards(…, by=("pool",))``."""
    return C.pools(df.where(C.base_quality(df)), high, low)


def make_candidates(df: DataFrame, view: str = "prompt", ids: DataFrame | None = None, mapping: DataFrame | None = None, groups: tuple[str, ...] = (), hash_mod: int = 0, hash_keep: int = 0, **filters) -> DataFrame:
    """Rows with ``embed_text`` of a view (prompt, behavior, reasoning_excerpt) and its word count; blank views don't come out.

    Filters on native columns come before the view is made. A list of ids switches hash sampling off.
    """
    out = C.candidate_filter(df, **filters)
    if ids is not None:
        out = C.only_ids(out, ids)
    if mapping is not None:
        out = C.attach_group(out, mapping, groups)
    if hash_mod and ids is None:
        out = C.hash_sample(out, hash_mod, hash_keep)
    made = {"prompt": H.prompt_view, "reasoning_excerpt": H.excerpt_view, "behavior": behaviour_udf}[view]("text")
    out = out.withColumn("embed_text", made).where(strip("embed_text") != "")
    return out.withColumn("stats_embed_word_count", word_count("embed_text"))


def pack_by_length(df: DataFrame, length: str = "stats_tok_len", edges: tuple[int, ...] = (0, 128, 256, 512), order: tuple[str, ...] = (), id_col: str = "id") -> DataFrame:
    """One row an id, with its length bucket."""
    return C.length_buckets(C.keep_first(df.where(strip(id_col) != ""), id_col, *order, length), length, edges)


def prompt_cover(df: DataFrame, target: int, dim: int, mix: dict[str, float] = MIX, bits: int = 22, seed: int = 0, dense: float = 0.8, score: str = "prompt_tokens", share: float = 0.35, keep: int = 3, low: int = 0, high: int = 0, on_short: str = "fail") -> DataFrame:
    """``target`` varied rows by LSH bucket, shared out over the groups of ``mix``; no dataset over its share of a group.

    Buckets are taken by size and, for the rest, by hash. Fewer buckets than wanted are an error, or with
    ``on_short="warn"`` all that there are.
    """
    rows = df.where(F.col("mix_group").isin(*mix))
    if low or high:
        rows = rows.where(F.col("prompt_tokens").between(low, high or 2**31 - 1))
    keyed = L.lsh_keys(rows.select("id", "dataset", "mix_group", score, "embedding"), "embedding", dim, bits, seed).where("bucket_key is not null")
    out = None
    for group, k in L.largest_remainder(target, mix).items():
        if not k:
            continue
        best = L.bucket_top_distinct(keyed.where(F.col("mix_group") == group), "bucket_key", "dataset", score, "id", keep)
        buckets = L.dense_and_tail(best.groupBy("bucket_key").agg(F.max("bucket_count").alias("n")), k, "n", "bucket_key", dense, seed)
        near = best.join(buckets.select("bucket_key"), "bucket_key", "left_semi")
        picked = L.capped_pick(near, k, "dataset", "bucket_key", "bucket_count", "score", "id", share).withColumn("mix_group", F.lit(group))
        if on_short == "fail" and (n := picked.count()) < k:
            raise ValueError(f"{group}: {n} of {k}")
        out = picked if out is None else out.unionByName(picked)
    return out


def prompt_pack(cover: DataFrame, size: int, mix: dict[str, float] = MIX, dense: float = 0.8, seed: int = 0) -> DataFrame:
    """A smaller pack from a cover, in the same proportions."""
    parts = [L.dense_and_tail(cover.where(F.col("mix_group") == g), k, "bucket_count", "id", dense, seed) for g, k in L.largest_remainder(size, mix).items() if k]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bucket_pack(df: DataFrame, target: int, dim: int, group: str, by: str, quotas: dict[str, int], bits: int = 24, seed: int = 0, dense: float = 0.8, score: str = "prompt_tokens") -> DataFrame:
    """Rows of one mix group by LSH bucket and ``by`` (a domain, a length stratum, a tool sequence), with a quota for each value.

    Quotas beyond the number of buckets are borrowed from the others; the best row of a bucket stands for it.
    """
    rows = df.where((F.col("mix_group") == group) & F.col(by).isin(*quotas))
    keyed = L.lsh_keys(rows.select("id", by, score, "embedding"), "embedding", dim, bits, seed).where("bucket_key is not null")
    best = L.bucket_best(keyed, (by, "bucket_key"), score, "id")
    supply = {r[by]: r.n for r in best.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a quota
    out = None
    for value, k in L.borrow(quotas, supply).items():
        part = L.dense_and_tail(best.where(F.col(by) == value), min(k, target), "bucket_count", "id", dense, seed)
        out = part if out is None else out.unionByName(part)
    return out


def tool_pack(df: DataFrame, sketches: DataFrame, target: int, dim: int, bits: int = 24, seed: int = 0, per_sequence: int = 50, min_calls: int = 1, distinct: int = 200) -> DataFrame:
    """Rows of the tool group with a trace that passes the gate, the best of each (sequence, bucket), at most ``per_sequence`` of a sequence and, as far as there are, ``distinct`` sequences."""
    traces = C.keep_first(K.trace_gate(sketches, "embed_text", min_calls), "id", "embed_text").select("id", F.regexp_extract("embed_text", r"(?m)^TOOL_SEQ: (.*)$", 1).alias("tool_seq"))
    rows = df.where("mix_group = 'tool'").join(traces, "id")
    keyed = L.lsh_keys(rows.select("id", "tool_seq", "stats_embed_word_count", "embedding"), "embedding", dim, bits, seed).where("bucket_key is not null")
    best = L.bucket_best(keyed, ("tool_seq", "bucket_key"), "stats_embed_word_count", "id")
    ranked = best.withColumn("rank", F.struct((-F.col("bucket_count")).alias("c"), (-F.col("score")).alias("s"), "id"))
    return L.sequence_backfill(ranked, target, "tool_seq", "rank", per_sequence, distinct).drop("rank")


def manifold_report(df: DataFrame, dim: int, k: int = 10, id_col: str = "id", vec_col: str = "embedding", label: str = "mix_group") -> dict[str, float]:
    """Duplicate rates, purity and balance of a table of vectors, neighbours taken of a twentieth of the ids by hash."""
    asked = df.where(F.pmod(F.xxhash64(id_col), F.lit(20)) == 0)
    near = G.knn(df, asked, k, id_col, vec_col)
    out = {f"nn1_ge_{r.threshold}": r.rate for r in G.near_duplicate_rates(near).collect()}
    out["purity"] = G.label_purity(near, df, id_col, label).first().purity
    sizes = df.groupBy(F.col(label).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return out | G.balance(sizes).first().asDict() | {f"pc{i + 1}": float(v) for i, v in enumerate(G.pca(df, vec_col, dim)[2])}
