"""Router statistics: usage and saliency of experts, rankings, coverage sets, what to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def saliency(facts: DataFrame, layer: str = "layer", expert: str = "expert", gate: str = "gate", norm: str = "norm") -> DataFrame:
    """(layer, expert, count, gate_sum, norm_sum, gate_norm_sum, gate_norm_mean) with rows of zeros for pairs never met."""
    s = facts.groupBy(layer, expert).agg(F.count(F.lit(1)).alias("count"), F.sum(gate).alias("gate_sum"), F.sum(norm).alias("norm_sum"), F.sum(F.col(gate) * F.col(norm)).alias("gate_norm_sum"))
    layers, experts = facts.select(layer).distinct(), facts.select(expert).distinct()
    grid = F.broadcast(layers).join(experts)  # layers times experts of one model
    full = grid.join(s, [layer, expert], "left").fillna(0).fillna(0.0)
    return full.withColumn("gate_norm_mean", F.col("gate_norm_sum") / F.greatest(F.lit(1), F.col("count")))


def weighted_saliency(facts: DataFrame, weight: str = "weight", layer: str = "layer", expert: str = "expert", gate: str = "gate", norm: str = "norm") -> DataFrame:
    """(layer, expert, weighted_sum, positive_sum, negative_sum, positive_count, negative_count): sums of gate times norm, each times the token's weight, in all and by the weight's sign."""
    mass, w = F.col(gate) * F.col(norm), F.coalesce(F.col(weight), F.lit(0.0))
    part = lambda test, x: F.sum(F.when(test, x).otherwise(0.0))
    return facts.groupBy(layer, expert).agg(
        F.sum(w * mass).alias("weighted_sum"), part(w > 0, w * mass).alias("positive_sum"), part(w < 0, -w * mass).alias("negative_sum"), F.count_if(w > 0).alias("positive_count"), F.count_if(w < 0).alias("negative_count")
    )


def usage(facts: DataFrame, token: str, prob: str, layer: str = "layer", expert: str = "expert", bins: int = 200) -> tuple[DataFrame, DataFrame]:
    """((layer, tokens, selections, prob_mean, top1_mean, top2_mean), (layer, bin, n)) of the probabilities with which experts are chosen; the histogram spans 0 to 1."""
    from curatrix.operators.scoring import histogram

    per = facts.groupBy(layer, token).agg(F.count(F.lit(1)).alias("k"), F.sum(prob).alias("s"), F.sort_array(F.collect_list(prob), asc=False).alias("p"))  # few experts a token
    means = per.groupBy(layer).agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("k").alias("selections"), (F.sum("s") / F.sum("k")).alias("prob_mean"), F.avg(F.get("p", F.lit(0))).alias("top1_mean"), F.avg(F.get("p", F.lit(1))).alias("top2_mean")
    )
    return means, histogram(facts, (layer,), prob, 0.0, 1.0, bins)


def domain_mass(tables: dict[str, tuple[DataFrame, float]], mass: str = "gate_norm_sum", layer: str = "layer", expert: str = "expert") -> DataFrame:
    """(layer, expert, mass): the weighted masses of several domains' tables; where a domain has no row, it adds nothing."""
    parts = [t.select(layer, expert, (F.col(mass) * float(w)).alias("m")) for t, w in tables.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(layer, expert).agg(F.sum("m").alias("mass"))


def ranking(sal: DataFrame, mass: str = "gate_norm_sum", layer: str = "layer", expert: str = "expert") -> DataFrame:
    """``sal`` with ``rank`` in its layer by mass."""
    return sal.withColumn("rank", F.row_number().over(Window.partitionBy(layer).orderBy(F.desc(mass), expert)))


def concentration(ranked: DataFrame, mass: str = "gate_norm_sum", layer: str = "layer", tops: tuple[int, ...] = (4, 8, 16)) -> DataFrame:
    """(layer, top4, top8, top16): the share of the mass that the first experts have."""
    return ranked.groupBy(layer).agg(*[(F.sum(F.when(F.col("rank") <= t, F.col(mass)).otherwise(0.0)) / F.sum(mass)).alias(f"top{t}") for t in tops])


def coverage(sal: DataFrame, share: float, mass: str = "gate_norm_sum", keys: tuple[str, ...] = ("layer",), expert: str = "expert") -> DataFrame:
    """The smallest sets of experts with the greatest mass that hold ``share`` of it; a group without mass has none."""
    w = Window.partitionBy(*keys)
    run = F.sum(mass).over(w.orderBy(F.desc(mass), expert).rowsBetween(Window.unboundedPreceding, -1))
    return sal.withColumn("__b", F.coalesce(run, F.lit(0.0))).withColumn("__t", F.sum(mass).over(w)).where("__t > 0").where(F.col("__b") < share * F.col("__t")).drop("__b", "__t")


def union_keep(sal: DataFrame, share: float, core: int, weights: dict[str, float] | None = None, domain: str = "domain", layer: str = "layer", expert: str = "expert", mass: str = "gate_norm_sum", cap: int | None = None) -> DataFrame:
    """(layer, expert): the coverage sets of all domains and the ``core`` best by weighted mass; with ``cap`` at most so many a layer, the core first."""
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col(domain)), F.lit(1.0)) if weights else F.lit(1.0)
    total = sal.groupBy(layer, expert).agg(F.sum(F.col(mass) * weight).alias("m"))
    ranked = ranking(total, "m", layer, expert)
    covered = coverage(sal, share, mass, (layer, domain), expert).select(layer, expert).distinct().withColumn("covered", F.lit(True))
    kept = ranked.join(covered, [layer, expert], "left").where((F.col("rank") <= core) | F.col("covered"))
    if cap is not None:
        w = Window.partitionBy(layer).orderBy((F.col("rank") > core).cast("int"), "rank")
        kept = kept.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(cap, core))
    return kept.select(layer, expert)


def core_and_fill(sal: DataFrame, keep: int, core: int, layer: str = "layer", expert: str = "expert", mass: str = "gate_norm_sum", multiple: int = 4) -> DataFrame:
    """(layer, expert): the ``core`` first by mass and by count, then the next by mass up to ``keep``, rounded to a ``multiple``."""
    n = max(multiple, round(keep / multiple) * multiple)
    by_mass, by_count = Window.partitionBy(layer).orderBy(F.desc(mass), expert), Window.partitionBy(layer).orderBy(F.desc("count"), expert)
    r = sal.withColumn("a", F.row_number().over(by_mass)).withColumn("b", F.row_number().over(by_count))
    first = (F.col("a") > core) & (F.col("b") > core)
    return r.withColumn("p", F.row_number().over(Window.partitionBy(layer).orderBy(first.cast("int"), "a"))).where(F.col("p") <= n).select(layer, expert)


def coactivation(facts: DataFrame, token: str, layer: str = "layer", expert: str = "expert") -> DataFrame:
    """(layer, expert_i, expert_j, n): how often two experts serve the same token; an expert's list per token is short (top k)."""
    sets = facts.groupBy(layer, token).agg(F.sort_array(F.collect_set(expert)).alias("e"))
    pairs = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice(F.col("e"), i + 2, F.size("e")), lambda y: F.struct(x.alias("i"), y.alias("j")))))
    return sets.select(layer, F.explode(pairs).alias("p")).groupBy(layer, F.col("p.i").alias("expert_i"), F.col("p.j").alias("expert_j")).agg(F.count(F.lit(1)).alias("n"))


def keep_counts(effective: dict[int, float], total: int, least: int, most: int) -> dict[int, int]:
    """Experts to keep in each layer: in proportion to its effective number, within bounds, adding up to ``total`` as far as these allow."""
    s = sum(effective.values()) or 1.0
    out = {k: min(most, max(least, round(total * v / s))) for k, v in effective.items()}
    order = sorted(out, key=lambda k: (-effective[k], k))
    while (gap := total - sum(out.values())) != 0:
        step = 1 if gap > 0 else -1
        free = [k for k in (order if gap > 0 else order[::-1]) if least <= out[k] + step <= most]
        if not free:
            break
        for k in free[: abs(gap)]:
            out[k] += step
    return out


def moe_bytes(layers: str, experts: str, hidden: str, inner: str, bits: float = 4.25):
    """(parameters, bytes) of gated expert weights: three matrices an expert."""
    params = F.col(layers) * F.col(experts) * 3 * F.col(hidden) * F.col(inner)
    return params, params * bits / 8
