"""Token scores: spans, perplexity, confident conflicts, histograms, divergences, the gate and comparisons of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import erf
from curatrix.operators.profile import column_quantiles, quantiles


def in_spans(start: Column, stop: Column, spans: Column) -> Column:
    """Whether a token overlaps one of the spans; an empty token never does."""
    return (stop > start) & F.exists(spans, lambda s: (stop > s["start"]) & (start < s["stop"]))


def perplexity(tokens: DataFrame, keys: tuple[str, ...], logprob: str = "logprob", clamp: float | None = 30.0) -> DataFrame:
    """(*keys, tokens, nll_sum, nll_mean, ppl) over finite log-probabilities; no token gives NaN and 0. ``clamp`` bounds the mean before exp."""
    lp = F.when(F.isnan(logprob) | (F.abs(logprob) == float("inf")), None).otherwise(F.col(logprob))
    out = tokens.groupBy(*keys).agg(F.count(lp).alias("tokens"), F.coalesce(-F.sum(lp), F.lit(float("nan"))).alias("nll_sum"), F.coalesce(-F.avg(lp), F.lit(float("nan"))).alias("nll_mean"))
    top = F.col("nll_mean") if clamp is None else F.when(F.isnan("nll_mean"), F.col("nll_mean")).otherwise(F.least(F.lit(clamp), F.col("nll_mean")))
    return out.withColumn("ppl", F.exp(top))


def topk_entropy(logprobs: Column) -> Column:
    """Entropy of the k probabilities, brought to sum 1, over ln k; for k = 1 over 1e-12."""
    p = F.transform(logprobs, lambda x: F.exp(x.cast("double")))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))
    return h / F.greatest(F.log(F.size(logprobs).cast("double")), F.lit(1e-12))


def quadrants(tokens: DataFrame, keys: tuple[str, ...], p: str, h: str, q: float = 0.15) -> DataFrame:
    """(*keys, t_p, t_h, cc_rate, lh, hl, hh): thresholds are the q-quantiles of each group, cc the share low in both."""
    each = column_quantiles(tokens, (p, h), {"t": q}, *keys)
    cut = each.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("t"))).alias(n) for c, n in ((p, "t_p"), (h, "t_h"))])
    low_p, low_h = F.col(p) <= F.col("t_p"), F.col(h) <= F.col("t_h")
    share = lambda c: F.avg(c.cast("double"))
    return tokens.join(cut, list(keys)).groupBy(*keys).agg(
        F.max("t_p").alias("t_p"), F.max("t_h").alias("t_h"), share(low_p & low_h).alias("cc_rate"), share(low_p & ~low_h).alias("lh"), share(~low_p & low_h).alias("hl"), share(~low_p & ~low_h).alias("hh")
    )


def bin_of(x: str | Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value; the last bin holds its upper edge, values outside have none."""
    v = F.col(x) if isinstance(x, str) else x
    return F.when((v >= low) & (v <= high), F.least(F.lit(bins - 1), F.floor((v - low) / (high - low) * bins)).cast("int"))


def histogram(df: DataFrame, keys: tuple[str, ...], x: str, low: float, high: float, bins: int) -> DataFrame:
    """(*keys, bin, n) of the values within the range."""
    return df.select(*keys, bin_of(x, low, high, bins).alias("bin")).where("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def histogram_2d(df: DataFrame, keys: tuple[str, ...], x: str, y: str, xr: tuple[float, float, int], yr: tuple[float, float, int]) -> DataFrame:
    """(*keys, ix, iy, n) of the values within both ranges."""
    return df.select(*keys, bin_of(x, *xr).alias("ix"), bin_of(y, *yr).alias("iy")).where("ix is not null and iy is not null").groupBy(*keys, "ix", "iy").agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(hist: DataFrame, keys: tuple[str, ...], q: float, low: float, high: float, bins: int) -> DataFrame:
    """(*keys, value): the upper edge of the first bin up to which the share ``q`` lies."""
    per = Window.partitionBy(*keys)
    run = hist.withColumn("c", F.sum("n").over(per.orderBy("bin"))).withColumn("t", F.sum("n").over(per))
    return run.where(F.col("c") >= F.col("t") * q).groupBy(*keys).agg((low + (F.min("bin") + 1) * ((high - low) / bins)).alias("value"))


def conflicts_from_histogram(hist: DataFrame, cuts: DataFrame, keys: tuple[str, ...], xr: tuple[float, float, int], yr: tuple[float, float, int], rule: str = "straddle") -> DataFrame:
    """(*keys, cc_rate) of a 2-d histogram at thresholds (t_p, t_h) from elsewhere; a bin counts below a threshold if it begins there or, with ``rule="middle"``, has its middle there."""
    edge = lambda i, r: r[0] + (F.col(i) + (0.5 if rule == "middle" else 0.0)) * ((r[1] - r[0]) / r[2])
    low = (edge("ix", xr) <= F.col("t_p")) & (edge("iy", yr) <= F.col("t_h"))
    return hist.join(F.broadcast(cuts), list(keys)).groupBy(*keys).agg((F.sum(F.when(low, F.col("n")).otherwise(0)) / F.sum("n")).alias("cc_rate"))


def js_divergence(a: DataFrame, b: DataFrame, keys: tuple[str, ...], bins: tuple[str, ...], dialect: str = "skip", eps: float = 1e-12) -> DataFrame:
    """(*keys, js) in nats of two histograms (n); a group of which one is empty has 0.

    Dialects: ``skip`` leaves bins without mass out and bounds only the mean by eps; ``clip`` bounds all probabilities
    by eps but takes the mean of the unbounded; ``clip_mean`` the mean of the bounded; ``add`` adds eps to every bin.
    """
    on = [*keys, *bins]
    both = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), on, "full").select(*on, F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    per = Window.partitionBy(*keys)
    r = both.withColumn("ta", F.sum("na").over(per)).withColumn("tb", F.sum("nb").over(per)).where("ta > 0 and tb > 0").withColumn("p", F.col("na") / F.col("ta")).withColumn("q", F.col("nb") / F.col("tb"))
    p, q = F.col("p"), F.col("q")
    if dialect == "skip":
        m = F.greatest((p + q) / 2, F.lit(eps))
        term = F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)
    else:
        x, y = (p + eps, q + eps) if dialect == "add" else (F.greatest(p, F.lit(eps)), F.greatest(q, F.lit(eps)))
        m = F.greatest((p + q) / 2, F.lit(eps)) if dialect == "clip" else (x + y) / 2
        term = x * F.log(x / m) + y * F.log(y / m)
    got = r.groupBy(*keys).agg((F.sum(term) / 2).alias("js"))
    groups = both.select(*keys).distinct()
    return groups.join(got, list(keys), "left").select(*keys, F.coalesce("js", F.lit(0.0)).alias("js"))


# The limits of the acceptance gate.
LIMITS = {"rel_ppl": 0.05, "abs_ppl": 0.25, "cc_rate": 0.002, "mean_prob": 0.02, "js2d": 0.02}


def gate(base: DataFrame, other: DataFrame, js: DataFrame, keys: tuple[str, ...] = ("pack", "seq_len"), ppl_rule: str = "both", limits: dict[str, float] | None = None) -> DataFrame:
    """(*keys, d_ppl, d_cc, d_p, js, accepted) of two runs (ppl, cc_rate, mean_prob) where both have a row.

    ``ppl_rule``: ``both`` the absolute and the relative limit must hold, ``either`` one suffices.
    """
    lim = LIMITS | (limits or {})
    b = base.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("ppl", "cc_rate", "mean_prob")])
    j = b.join(other.select(*keys, "ppl", "cc_rate", "mean_prob"), list(keys)).join(js, list(keys), "left")
    d = j.select(*keys, "b_ppl", (F.col("ppl") - F.col("b_ppl")).alias("d_ppl"), (F.col("cc_rate") - F.col("b_cc_rate")).alias("d_cc"), (F.col("mean_prob") - F.col("b_mean_prob")).alias("d_p"), F.coalesce("js", F.lit(0.0)).alias("js"))
    absolute, relative = F.abs("d_ppl") <= lim["abs_ppl"], F.abs("d_ppl") <= lim["rel_ppl"] * F.col("b_ppl")
    ppl = absolute & relative if ppl_rule == "both" else absolute | relative
    ok = ppl & (F.abs("d_cc") <= lim["cc_rate"]) & (F.abs("d_p") <= lim["mean_prob"]) & (F.col("js") <= lim["js2d"])
    return d.withColumn("accepted", ok).drop("b_ppl")


def z_score(x: str, *keys: str) -> Column:
    """Deviation from the group's mean in population deviations; a deviation of 0 counts as 1e-9."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(x).over(w)
    return (F.col(x) - F.avg(x).over(w)) / F.when(sd == 0, 1e-9).otherwise(sd)


def degradation(deltas: DataFrame, key: str = "seq_len") -> DataFrame:
    """``deltas`` (d_ppl, d_cc, d_p, js) with the composite ``score``: the sum of the four z-scores, a lost probability counting up."""
    lost = deltas.withColumn("__l", -F.col("d_p"))
    return lost.withColumn("score", z_score("d_ppl", key) + z_score("d_cc", key) + z_score("js", key) + z_score("__l", key)).drop("__l")


def leaderboard(runs: DataFrame, model: str = "model", key: str = "seq_len") -> DataFrame:
    """(key, model, ppl, cc_rate, mean_prob, quality, place): means over packs and -z(ppl) - z(cc) + z(mean_prob)."""
    m = runs.groupBy(key, model).agg(F.avg("ppl").alias("ppl"), F.avg("cc_rate").alias("cc_rate"), F.avg("mean_prob").alias("mean_prob"))
    q = m.withColumn("quality", -z_score("ppl", key) - z_score("cc_rate", key) + z_score("mean_prob", key))
    return q.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("quality"), model)))


def pairwise_wins(runs: DataFrame, model: str = "model", keys: tuple[str, ...] = ("pack", "seq_len"), eps: float = 1e-9) -> DataFrame:
    """(model, wins): over shared packs, the other models it beats in mean perplexity, conflict rate and probability at once."""
    a, b = runs.alias("a"), runs.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col(f"a.{model}") != F.col(f"b.{model}")]
    d = a.join(b, on).groupBy(F.col(f"a.{model}").alias(model), F.col(f"b.{model}").alias("other")).agg(*[F.avg(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(c) for c in ("ppl", "cc_rate", "mean_prob")])
    win = (F.col("ppl") > eps) & (F.col("cc_rate") > eps) & (F.col("mean_prob") < -eps)
    return d.groupBy(model).agg(F.sum(win.cast("int")).alias("wins"))


def two_proportions(k1: str, n1: str, k2: str, n2: str) -> tuple[Column, Column]:
    """(z, p) of the difference of two shares, two-sided."""
    pool = (F.col(k1) + F.col(k2)) / (F.col(n1) + F.col(n2))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col(n1) + 1 / F.col(n2)))
    z = F.when(se > 0, (F.col(k2) / F.col(n2) - F.col(k1) / F.col(n1)) / se).otherwise(0.0)
    return z, 1 - erf(F.abs(z) / (2**0.5))


def welch(m1: str, v1: str, n1: str, m2: str, v2: str, n2: str) -> tuple[Column, Column]:
    """(z, p) of the difference of two means, two-sided, by the normal curve."""
    se = F.sqrt(F.col(v1) / F.col(n1) + F.col(v2) / F.col(n2))
    z = F.when(se > 0, (F.col(m2) - F.col(m1)) / se).otherwise(0.0)
    return z, 1 - erf(F.abs(z) / (2**0.5))


def interval(middle: Column, se: Column) -> tuple[Column, Column]:
    """The bounds of the 95 % interval around a normal estimate."""
    return middle - 1.96 * se, middle + 1.96 * se


def nll_interval(mean: str, variance: str, n: str) -> dict[str, Column]:
    """Bounds of a mean negative log-likelihood and of its perplexity; a count of 0 counts as 1, a negative variance as 0."""
    lo, hi = interval(F.col(mean), F.sqrt(F.greatest(F.lit(0.0), F.col(variance)) / F.greatest(F.lit(1), F.coalesce(n, F.lit(1)))))
    return {"nll_lo": lo, "nll_hi": hi, "ppl_lo": F.exp(lo), "ppl_hi": F.exp(hi)}


def delta_interval(m1: str, v1: str, n1: str, m2: str, v2: str, n2: str) -> tuple[Column, Column]:
    """Bounds of the difference of two means."""
    return interval(F.col(m2) - F.col(m1), F.sqrt(F.col(v1) / F.col(n1) + F.col(v2) / F.col(n2)))


def share_interval(p1: str, n1: str, p2: str, n2: str) -> tuple[Column, Column]:
    """Bounds of the difference of two shares."""
    part = lambda p, n: F.col(p) * (1 - F.col(p)) / F.greatest(F.lit(1), F.coalesce(n, F.lit(1)))
    return interval(F.col(p2) - F.col(p1), F.sqrt(part(p1, n1) + part(p2, n2)))


def verdicts(scored: DataFrame, key: str = "seq_len", eps_ppl: float = 0.0, eps_cc: float = 0.0, eps_js: float = 0.0) -> DataFrame:
    """``scored`` (:func:`degradation`) with ``z``, its score's own deviation, ``p`` and ``verdict``: worse, better or mixed.

    Worse (better) where perplexity, conflicts and, for worse, divergence all moved beyond their eps, z is 2 or more away
    and p below 0.05.
    """
    out = scored.withColumn("z", z_score("score", key))
    p = 1 - erf(F.abs("z") / (2**0.5))
    sure = (F.abs("z") >= 2) & (p < 0.05)
    worse = (F.col("d_ppl") > eps_ppl) & (F.col("d_cc") > eps_cc) & (F.col("js") > eps_js) & (F.col("z") > 0) & sure
    better = (F.col("d_ppl") < -eps_ppl) & (F.col("d_cc") < -eps_cc) & (F.col("z") < 0) & sure
    return out.withColumn("p", p).withColumn("verdict", F.when(worse, "worse").when(better, "better").otherwise("mixed"))


def accept_summary(lengths: DataFrame, accepted: str, block: int, *keys: str) -> DataFrame:
    """(*keys, n, mean, p50, p90, p99, rate) of accepted lengths; rate is the share of a block's tokens."""
    key = list(keys) or ["__all"]
    rows = lengths if keys else lengths.withColumn("__all", F.lit(0))
    plain = rows.groupBy(*key).agg(F.count(accepted).alias("n"), F.avg(accepted).alias("mean"), (F.sum(accepted) / F.greatest(F.lit(1), F.count(accepted) * block)).alias("rate"))
    return plain.join(quantiles(rows, accepted, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, *key), key).select(*keys, "n", "mean", "p50", "p90", "p99", "rate")


def token_regions(tokens: DataFrame, p: str, h: str, low: float = 0.15, high: float = 0.85, weights: tuple[float, float, float] = (1.0, -2.0, 0.25)) -> DataFrame:
    """``tokens`` with ``region`` (good, conflict, uncertain) and ``weight``; a null probability or entropy weighs 0."""
    each = column_quantiles(tokens, (p, h), {"t": low})
    cut = each.agg(*[F.max(F.when(F.col("column") == c, F.col("t"))).alias(n) for c, n in ((p, "__p"), (h, "__h"))])  # one row
    sure = F.col(h) <= F.col("__h")
    region = F.when(F.col(p).isNull() | F.col(h).isNull(), None).when((F.col(p) >= F.col("__p")) & sure, "good").when((F.col(p) < F.col("__p")) & sure, "conflict").otherwise("uncertain")
    out = tokens.join(F.broadcast(cut)).withColumn("region", region)
    weight = F.when(F.col("region") == "good", weights[0]).when(F.col("region") == "conflict", weights[1]).when(F.col("region") == "uncertain", weights[2]).otherwise(0.0)
    return out.withColumn("weight", weight).drop("__p", "__h")


def accepted_prefix(draft: Column, target: Column) -> Column:
    """How many tokens of the draft match the target before the first that doesn't."""
    same = F.zip_with(draft, target, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & x, 1).otherwise(0)).alias("n"), (a["on"] & x).alias("on")), lambda a: a["n"])
