"""Mixing sources to target weights: entropy balancing of documents, rounded into copies.

All documents start with one prior rate, that of the whole collection: budget over tokens. The rates that meet every
source's target of tokens and stay closest to the prior in (bounded) entropy are exponentially tilted ones, up to the
greatest number of repeats. Their multipliers solve a convex dual with one token constraint a source; Newton steps take
its gradient and curvature from the histogram of document sizes, which Spark sums up for all sources at once.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.tokens import label
from curatrix.session import cut_lineage


def rate(theta: Column, repeats: Column) -> Column:
    """The rate under tilt ``theta``: exponential far below ``repeats``, which it never passes."""
    return repeats / (F.lit(1.0) + F.exp(-theta))


#: A document with more than such a part of its source's target is a long one.
LONG = 200


class Balance(NamedTuple):
    """``tilt``: (key, a, b, c, mean, max_repeats) of each source that is used; ``state``: (key, gap, most, short, steps) of each source with a weight."""

    tilt: DataFrame
    state: DataFrame


def source_targets(weights: DataFrame) -> DataFrame:
    """(key, source, target, max_repeats) of each source of ``weights``; sources match without outer white space and case."""
    return weights.where(F.col("source").isNotNull()).groupBy(label("source").alias("key")).agg(
        F.min("source").alias("source"), F.coalesce(F.sum(F.col("target_weight") * F.col("budget_tokens")), F.lit(0.0)).alias("target"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("max_repeats")
    )


def solve(block: list[list[float]], gap: list[float]) -> list[float] | None:
    """The Newton step of one source: the solution of its one or two equations, or None where they are singular."""
    if len(gap) == 1:
        return [gap[0] / block[0][0]] if block[0][0] > 0 else None
    (a, b), (_, d) = block
    det = a * d - b * b
    return [(d * gap[0] - b * gap[1]) / det, (a * gap[1] - b * gap[0]) / det] if det > 1e-9 * max(a * d, 1e-300) else None


def balance(sized: DataFrame, weights: DataFrame, source: str = "source", size: str = "tokens", keep_sizes: bool = False, rounds: int = 60, close: float = 1e-6) -> Balance:
    """The solution of the dual of :func:`mix_sources`.

    A document of t tokens has the rate max_repeats / (1 + exp(-(a + b x + c))), where x is t over the source's mean and
    ``a`` stands for the prior. ``b`` is the multiplier of the source's token constraint; with ``keep_sizes`` ``c`` is that
    of a second one, on the number of documents, which keeps the source's mean size. A source's part of the dual is
    unbounded if even its greatest rates leave its gradient positive: it is short and used to the full. Newton steps
    are kept within the bracket of the sign change (one multiplier) or halved while the gradient grows (two).
    """
    spark = sized.sparkSession
    hist = cut_lineage(sized.where(F.col(size) > 0).groupBy(label(source).alias("key"), F.col(size).alias("t")).agg(F.count(F.lit(1)).alias("n")))
    supply = hist.groupBy("key").agg(F.sum(F.col("n") * F.col("t")).alias("supply"), F.sum("n").alias("documents"))
    # one row a source of the weights table
    rows = source_targets(weights).join(supply, "key", "left").select("key", "target", "max_repeats", F.coalesce("supply", F.lit(0)).alias("supply"), F.coalesce("documents", F.lit(0)).alias("documents")).collect()
    total, budget = sum(r.supply for r in rows), sum(r.target for r in rows)
    prior = budget / total if total else 0.0
    at: dict[str, dict] = {}
    for r in rows:
        most = r.max_repeats * r.supply
        q = min(max(prior / max(r.max_repeats, 1), 1e-6), 0.9)
        at[r.key] = {"a": math.log(q / (1 - q)), "b": 0.0, "c": 0.0, "m": r.max_repeats, "mean": r.supply / max(r.documents, 1), "target": r.target, "docs": r.documents * min(1.0, r.target / r.supply) if r.supply else 0.0, "most": most, "low": -math.inf, "high": math.inf, "gap": r.target - most, "steps": 0, "short": r.target > most, "open": 0 < r.target < most}
        if at[r.key]["open"] and keep_sizes:
            at[r.key]["docs"] = r.target / at[r.key]["mean"]
    x = F.col("t") / F.col("mean")
    for _ in range(rounds):
        busy = {k: v for k, v in at.items() if v["open"]}
        if not busy:
            break
        small = F.broadcast(spark.createDataFrame([(k, v["a"] + v["c"], v["b"], v["m"], v["mean"]) for k, v in busy.items()], "key string, a double, b double, m int, mean double"))
        r = rate(F.col("a") + F.col("b") * x, F.col("m"))
        bend = F.col("n") * r * (1 - r / F.col("m"))
        sums = hist.join(small, "key").groupBy("key").agg(F.sum(F.col("n") * r * x).alias("size"), F.sum(F.col("n") * r).alias("docs"), F.sum(bend * x * x).alias("xx"), F.sum(bend * x).alias("x"), F.sum(bend).alias("one"))
        for s in sums.collect():
            v = at[s.key]
            tokens = v["target"] / v["mean"] - s.size
            gaps = [tokens, v["docs"] - s.docs] if keep_sizes else [tokens]
            v["gap"], v["steps"] = tokens * v["mean"], v["steps"] + 1
            if abs(v["gap"]) <= close * v["target"] and (not keep_sizes or abs(gaps[1]) <= close * v["docs"]):
                v["open"] = False
                continue
            step = solve([[s.xx, s.x], [s.x, s.one]] if keep_sizes else [[s.xx]], gaps)
            if keep_sizes:
                worse = sum(g * g for g in gaps) > v.get("last", math.inf)
                if worse or step is None:  # back to the middle of the last step
                    v["b"], v["c"] = (v["b"] + v["was"][0]) / 2, (v["c"] + v["was"][1]) / 2
                else:
                    v["last"], v["was"] = sum(g * g for g in gaps), (v["b"], v["c"])
                    v["b"], v["c"] = v["b"] + step[0], v["c"] + step[1]
                continue
            v["low" if tokens > 0 else "high"] = v["b"]
            to = v["b"] + step[0] if step else math.nan
            if not v["low"] < to < v["high"]:
                to = (v["low"] + v["high"]) / 2 if math.isfinite(v["low"] + v["high"]) else v["b"] + math.copysign(max(1.0, abs(v["b"])), tokens)
            v["b"] = to
    used = [(k, v["a"] + v["c"] if not v["short"] and v["target"] < v["most"] else 700.0, v["b"], v["mean"], v["m"]) for k, v in at.items() if v["most"] > 0 and v["target"] > 0]
    return Balance(
        spark.createDataFrame(used, "key string, a double, b double, mean double, max_repeats int"),
        spark.createDataFrame([(k, float(v["gap"]), v["most"], v["short"], v["b"], v["c"], v["steps"]) for k, v in at.items()], "key string, gap double, most long, short boolean, b double, c double, steps int"),
    )


def mix_sources(sized: DataFrame, weights: DataFrame, solved: Balance | None = None, item: str = "doc_id", source: str = "source", size: str = "tokens", seed: int = 0, parts: int = 8192) -> DataFrame:
    """(item, source, tokens, copies) of the documents that are in the mix, each at most ``max_repeats`` times.

    ``sized`` has the tokens of each document, ``solved`` the solution of :func:`balance`. Rates are rounded down or up by
    the documents' hashes: against a threshold for each source at which its rounded tokens come closest to its target (of ``parts``
    thresholds): first the documents with more than a ``LONG``-th of the target, against one of their own, then the others. Sources without a weight, documents without tokens (null or blank text) and null sources
    aren't used; a source short of its target is used to the full. Ties and repeated texts are documents each.
    """
    solved = solved or balance(sized, weights, source, size)
    by = solved.tilt.join(source_targets(weights).select("key", F.col("source").alias("name"), "target"), "key")
    u = (F.pmod(F.xxhash64(F.col(item).cast("string"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    r = rate(F.col("a") + F.col("b") * F.col("t") / F.col("mean"), F.col("max_repeats"))
    rows = sized.where(F.col(size) > 0).select(F.col(item).alias("item"), label(source).alias("key"), F.col(size).alias("t"), u.alias("u"))
    mixed = rows.join(F.broadcast(by), "key").withColumn("r", F.least(r, F.col("max_repeats"))).withColumn("low", F.floor("r"))
    # a document is rounded up where the rest of its rate exceeds its hash by more than the source's threshold
    mixed = mixed.withColumn("bin", F.floor((F.col("r") - F.col("low") - F.col("u")) * (parts // 2)).cast("int")).withColumn("long", F.col("t") > F.col("target") / LONG)
    can = F.col("low") < F.col("max_repeats")
    sums = cut_lineage(
        mixed.groupBy("key", "target", "long", "bin").agg(
            F.sum(F.col("low") * F.col("t")).alias("sure"), F.sum((F.col("r") - F.col("low")) * F.col("t")).alias("rest"), F.sum(F.when(can, F.col("t")).otherwise(0)).alias("more")
        )
    )
    # the long ones come as close to what their rates give as they can, the others make up for what is left
    longs = closest(sums.where("long"), sums.where("long").groupBy("key").agg(F.sum("rest").alias("need")), parts)
    needs = sums.groupBy("key", "target").agg(F.sum("sure").alias("sure")).join(longs.select("key", F.col("reached").alias("by_long")), "key", "left")
    others = closest(sums.where("not long"), needs.select("key", (F.col("target") - F.col("sure") - F.coalesce("by_long", F.lit(0))).alias("need")), parts)
    names = longs.select("key", F.col("edge").alias("long_edge")).join(others.select("key", "edge"), "key", "full")
    edge = names.select("key", F.coalesce("long_edge", F.lit(parts)).alias("long_edge"), F.coalesce("edge", F.lit(parts)).alias("edge"))
    copies = (F.col("low") + F.when(can & (F.col("bin") >= F.when(F.col("long"), F.col("long_edge")).otherwise(F.col("edge"))), 1).otherwise(0)).cast("int")
    out = mixed.join(F.broadcast(edge), "key").withColumn("copies", copies).where("copies > 0")
    return out.select(F.col("item").alias(item), F.col("name").alias("source"), F.col("t").alias("tokens"), "copies")


def closest(sums: DataFrame, needs: DataFrame, parts: int) -> DataFrame:
    """(key, edge, reached): the threshold from which on the tokens ``more`` of the bins of ``sums`` come closest to what each key needs; ``parts`` where none is closer."""
    down = Window.partitionBy("key").orderBy(F.desc("bin"))
    reach = sums.groupBy("key", "bin").agg(F.sum("more").alias("more")).withColumn("sum", F.sum("more").over(down)).join(needs, "key")
    best = reach.groupBy("key").agg(F.min(F.struct(F.abs(F.col("sum") - F.col("need")).alias("off"), "bin", "sum")).alias("b"), F.max(F.abs("need")).alias("none"))
    nothing = F.col("none") <= F.col("b.off")
    return best.select("key", F.when(nothing, F.lit(parts)).otherwise(F.col("b.bin")).alias("edge"), F.when(nothing, F.lit(0)).otherwise(F.col("b.sum")).alias("reached"))


def mix_report(weights: DataFrame, solved: Balance, mixed: DataFrame) -> DataFrame:
    """(source, target_tokens, most_tokens, max_repeats, mixed_tokens, target_share, mixed_share, multiplier, short) of each source of ``weights``.

    ``most_tokens`` is what a source gives at its greatest rates, ``multiplier`` that of its token constraint and ``short``
    whether its part of the dual is unbounded.
    """
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    total = got.agg(F.coalesce(F.sum("mixed_tokens"), F.lit(0)).alias("all"))
    budget = weights.agg(F.max("budget_tokens").alias("budget"))
    return (
        source_targets(weights)
        .join(solved.state, "key")
        .join(got, "source", "left")
        .crossJoin(F.broadcast(total))  # one row each
        .crossJoin(F.broadcast(budget))
        .select(
            "source",
            F.col("target").alias("target_tokens"),
            F.col("most").alias("most_tokens"),
            "max_repeats",
            F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
            (F.col("target") / F.col("budget")).alias("target_share"),
            F.when(F.col("all") > 0, F.coalesce("mixed_tokens", F.lit(0)) / F.col("all")).otherwise(0.0).alias("mixed_share"),
            F.col("b").alias("multiplier"),
            "short",
        )
    )
