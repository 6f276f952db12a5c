"""Embedding geometry: neighbours, duplicates, purity, projections, density bins, balance of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.operators.profile import column_quantiles


def l2_norm(vec: str) -> Column:
    """Length of a vector, summed in doubles."""
    return F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def knn(df: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, block: int = 8192) -> DataFrame:
    """(query, neighbour, cosine): the ``k`` most similar rows of ``df`` to each query, itself left out; ties go to the smaller id.

    Queries are held against all rows in blocks of ``block``; each task keeps its own best for every query, and those
    meet by query. Null vectors and zero vectors are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    clean = lambda d: d.where(F.col(vec_col).isNotNull() & F.exists(vec_col, lambda x: x != 0)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    total = queries.count()
    rows, out = clean(df), None
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // block))))
    for b in range(max(1, -(-total // block))):
        asked = clean(queries).where(part == b).toPandas()
        if asked.empty:
            continue
        q = np.stack(asked["vec"].to_list()).astype(np.float64)
        sent = df.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), q / np.linalg.norm(q, axis=1, keepdims=True)))

        def run(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, q = sent.value
            for p in parts:
                if p.empty:
                    continue
                x = np.stack(p["vec"].to_list()).astype(np.float64)
                ids = p["id"].to_numpy()
                s = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
                s[names[:, None] == ids[None, :]] = -9
                # all that reach the k-th cosine, so that ties are settled by id further on
                edge = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(names), -9.0)
                i, j = np.nonzero((s >= edge[:, None]) & (s > -9))
                yield pd.DataFrame({"query": names[i], "neighbour": ids[j], "cosine": s[i, j]})

        found = rows.mapInPandas(run, f"query {kind}, neighbour {kind}, cosine double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return df.sparkSession.createDataFrame([], f"query {kind}, neighbour {kind}, cosine double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_duplicate_rates(near: DataFrame, thresholds: tuple[float, ...] = (0.99, 0.995, 0.999, 0.9995)) -> DataFrame:
    """(threshold, rate): the share of queries whose nearest neighbour is that similar."""
    first = near.where("rank = 1")
    at = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    return first.select("cosine", at).groupBy("threshold").agg(F.avg((F.col("cosine") >= F.col("threshold")).cast("double")).alias("rate"))


def label_purity(near: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(purity): the mean share of neighbours with the query's label."""
    a = labels.select(F.col(id_col).alias("query"), F.col(label).alias("a"))
    b = labels.select(F.col(id_col).alias("neighbour"), F.col(label).alias("b"))
    per = near.join(a, "query").join(b, "neighbour").groupBy("query").agg(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")).alias("p"))
    return per.agg(F.avg("p").alias("purity"))


def neighbour_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(overlap): the mean share of the ``k`` neighbours that two neighbour tables have in common."""
    both = a.where(F.col("rank") <= k).select("query", "neighbour").join(b.where(F.col("rank") <= k).select("query", "neighbour"), ["query", "neighbour"])
    n = both.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return a.select("query").distinct().join(n, "query", "left").agg(F.avg(F.coalesce("n", F.lit(0)) / k).alias("overlap"))


def outliers(near: DataFrame, share: float = 0.001, least: int = 10, most: int = 200) -> DataFrame:
    """The queries with the least similar nearest neighbours: a ``share`` of them, ``least`` at least, ``most`` at most."""
    first = near.where("rank = 1")
    return first.orderBy("cosine", "query").limit(min(most, max(least, int(share * first.count())))).select("query", "cosine")


def pca(df: DataFrame, vec_col: str, dim: int, k: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, mean, explained share) of all rows, from sums that each task adds up; the largest loading of a component is positive."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, m = 0, np.zeros(dim), np.zeros((dim, dim))
        for p in parts:
            rows = [v for v in p[vec_col] if v is not None and len(v) == dim]
            if rows:
                x = np.stack(rows).astype(np.float64)
                n, s, m = n + len(x), s + x.sum(0), m + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "m": [m.tobytes()]})

    def add(p: pd.DataFrame) -> pd.DataFrame:
        total = lambda c: np.sum([np.frombuffer(bytes(b)) for b in p[c]], axis=0).tobytes()
        return pd.DataFrame({"slot": p["slot"].iloc[:1], "n": [p["n"].sum()], "s": [total("s")], "m": [total("m")]})

    # sums of dim² numbers meet sixteen at a time, so that one row comes to the driver
    rows = df.select(vec_col)
    tasks = rows.rdd.getNumPartitions()
    level = rows.mapInPandas(sums, "n long, s binary, m binary").withColumn("slot", F.spark_partition_id())
    while tasks > 1:
        level, tasks = level.withColumn("slot", F.floor(F.col("slot") / 16).cast("int")).groupBy("slot").applyInPandas(add, "slot int, n long, s binary, m binary"), -(-tasks // 16)
    n, s, m = 0, np.zeros(dim), np.zeros((dim, dim))
    for r in level.collect():
        n, s, m = n + r.n, s + np.frombuffer(bytes(r.s)), m + np.frombuffer(bytes(r.m)).reshape(dim, dim)
    if n < 2:
        return np.zeros((k, dim)), s / max(n, 1), np.zeros(k)
    mean = s / n
    values, vectors = np.linalg.eigh(m / n - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    comp = vectors[:, order].T
    comp *= np.sign(comp[np.arange(k), np.abs(comp).argmax(1)])[:, None]
    return comp, mean, values[order] / values.sum()


def project(df: DataFrame, vec_col: str, components: np.ndarray, mean: np.ndarray, names: tuple[str, ...] = ("pca_x", "pca_y", "pca_z")) -> DataFrame:
    """``df`` with the coordinates of its vectors along the components, without a Python worker."""
    out = df
    for name, c in zip(names, components):
        weights = F.array(*[F.lit(float(x)) for x in c])
        shift = float(c @ mean)
        dot = F.aggregate(F.zip_with(F.col(vec_col), weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn(name, dot - F.lit(shift))
    return out


def density_bins(df: DataFrame, x: str, y: str, z: str, groups: tuple[str, ...], grid_2d: int = 256, grid_3d: int = 96, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(kind, *groups, bx, by, bz, count): rows in the squares of three planes and in the cubes; an axis not used is -1."""
    found = {r["column"]: (r.low, r.high) for r in column_quantiles(df, (x, y, z), {"low": low, "high": high}).collect()}  # one row an axis
    q = [found.get(c, (0.0, 1.0)) for c in (x, y, z)]

    def cell(i: int, c: str, n: int) -> Column:
        lo, hi = q[i]
        width = (hi - lo) or 1.0
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - lo) / width * n))).cast("int")

    none = F.lit(-1)
    a, b, c = (cell(i, v, grid_2d) for i, v in enumerate((x, y, z)))
    u, v, w = (cell(i, s, grid_3d) for i, s in enumerate((x, y, z)))
    make = lambda kind, bx, by, bz: F.struct(F.lit(kind).alias("kind"), bx.alias("bx"), by.alias("by"), bz.alias("bz"))
    bins = F.explode(F.array(make("xy", a, b, none), make("xz", a, none, c), make("yz", none, b, c), make("xyz", u, v, w))).alias("bin")
    return df.select(*groups, bins).groupBy("bin.kind", *groups, "bin.bx", "bin.by", "bin.bz").agg(F.count(F.lit(1)).alias("count"))


def density_stats(bins: DataFrame, groups: tuple[str, ...], kind: str = "xyz", grid: int = 96) -> DataFrame:
    """(*groups, points, cells, mean_points, occupancy) of one kind of bins; a cell of two groups counts once in each."""
    return bins.where(F.col("kind") == kind).groupBy(*groups).agg(F.sum("count").alias("points"), F.count(F.lit(1)).alias("cells")).withColumn("mean_points", F.col("points") / F.col("cells")).withColumn("occupancy", F.col("cells") / float(grid**3))


def balance(counts: DataFrame, n: str = "n") -> DataFrame:
    """(groups, gini, effective, inverse_simpson, top_share) of a table of group counts; a single small table by nature."""
    w = Window.orderBy(n, *[c for c in counts.columns if c != n])
    total, size = F.sum(n).over(Window.partitionBy()), F.count(F.lit(1)).over(Window.partitionBy())
    r = counts.withColumn("i", F.row_number().over(w)).withColumn("t", total).withColumn("g", size).withColumn("p", F.col(n) / F.col("t"))
    return r.agg(
        F.max("g").alias("groups"),
        (F.sum((2 * F.col("i") - F.col("g") - 1) * F.col(n)) / F.max(F.col("g") * F.col("t"))).alias("gini"),
        F.exp(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("effective"),
        (1 / F.sum(F.col("p") * F.col("p"))).alias("inverse_simpson"),
        F.max("p").alias("top_share"),
    )


def kmeans_sizes(df: DataFrame, vec_col: str, k: int, seed: int = 0, rounds: int = 25) -> DataFrame:
    """(cluster, n) of spherical k-means, empty clusters with 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.where(F.exists(vec_col, lambda v: v != 0)).select(array_to_vector(F.transform(vec_col, lambda v: v.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(x)
    sizes = model.transform(x).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster")).join(sizes, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"))
