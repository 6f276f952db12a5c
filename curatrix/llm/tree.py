"""The spanning tree of a neighbour graph and its hierarchy: Boruvka rounds, condensed tree, selection by stability.

All weights are similarities, so trees are greatest ones and a hierarchy is read from the most similar level down.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.session import cut_lineage

#: Choices followed from each component in a round, as a power of two.
DOUBLINGS = 2
#: Edges between components that one task ends the tree with, and edges of the tree that one task condenses (24 bytes each).
REST, BAND = 200_000, 1_000_000
EDGE = "a long, b long, s double, u long, v long"


def density(similarity: np.ndarray | float) -> np.ndarray | float:
    """One over the Euclidean distance of unit vectors with this cosine."""
    return 1.0 / np.sqrt(np.maximum(2.0 - 2.0 * np.asarray(similarity, float), 1e-6))


def boruvka_round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moved, taken): each component takes its best edge and moves to the root that its choices lead to.

    ``edges`` has one row (a, b, s, u, v) with a < b per pair of components; u, v are the ends that the edge had at first.
    Equal edges are ordered by u and v, so the choices form no cycle but pairs that choose each other, of which the
    smaller is the root. Chains are followed through 2 ** ``DOUBLINGS`` choices; components further from their root stay
    for the next round. ``moved`` is (c, root), ``taken`` the edges (u, v, s) of the tree.
    """
    best = F.max(F.struct("s", "u", "v", "p")).alias("e")
    both = edges.select(F.col("a").alias("c"), F.col("b").alias("p"), "s", "u", "v").unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("p"), "s", "u", "v"))
    choice = cut_lineage(both.groupBy("c").agg(best).select("c", "e.*"))
    other = choice.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    up = choice.join(other, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("root"), "u", "v", "s")
    for _ in range(DOUBLINGS):
        up = up.join(up.select(F.col("c").alias("root"), F.col("root").alias("next")), "root").select("c", F.col("next").alias("root"), "u", "v", "s")
    up = cut_lineage(up)
    moved = cut_lineage(up.join(up.where("c = root").select("root"), "root", "left_semi"))
    return moved.select("c", "root"), moved.where("c <> root").select("u", "v", "s")


def contract(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """The edges between different components after ``moved`` (c, root), the best of each pair."""
    a = moved.select(F.col("c").alias("a"), F.col("root").alias("ra"))
    b = moved.select(F.col("c").alias("b"), F.col("root").alias("rb"))
    e = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"), "s", "u", "v")
    best = F.max(F.struct("s", "u", "v")).alias("e")
    return e.where(F.col("x") != F.col("y")).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(best).select("a", "b", "e.*")


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def order(s: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Edges from the best down, equal ones as in :func:`boruvka_round`."""
    return np.lexsort((v, u, s))[::-1]


def kruskal(table: pa.Table) -> pa.Table:
    """The tree edges (u, v, s) among edges (a, b, s, u, v)."""
    a, b, s, u, v = (table.column(c).to_numpy() for c in ("a", "b", "s", "u", "v"))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = list(range(len(names)))
    keep = []
    for i in order(s, u, v).tolist():
        x, y = find(parent, a[i]), find(parent, b[i])
        if x != y:
            parent[x] = y
            keep.append(i)
    return pa.table({"u": u[keep], "v": v[keep], "s": s[keep]})


def spanning_tree(edges: DataFrame, rest: int = REST, least_rounds: int = 1) -> DataFrame:
    """(u, v, s): the greatest spanning forest of the edges (u, v, s), by distributed rounds of Boruvka.

    When at most ``rest`` edges between components are left, one task takes the tree's last edges from them; with equal
    edges ordered alike everywhere, the tree is the same for any ``rest``.
    """
    now = edges.where("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max("s").alias("s"))
    now = cut_lineage(now.select("a", "b", "s", F.col("a").alias("u"), F.col("b").alias("v")))
    tree = None
    rounds = 0
    while (left := now.count()) and (left > rest or rounds < least_rounds):
        moved, taken = boruvka_round(now)
        now = cut_lineage(contract(now, moved))
        tree = taken if tree is None else tree.unionByName(taken)
        rounds += 1
    last = cut_lineage(now.groupBy(F.lit("").alias("all")).applyInArrow(kruskal, "u long, v long, s double"))
    return last if tree is None else tree.unionByName(last)


class Forest:
    """Components of the hierarchy while edges come in from the most similar down.

    A component below ``least`` rows keeps them by name. When it reaches ``least`` it becomes a cluster, which rows then
    join one by one; where two clusters meet, both end and a new one begins.
    """

    def __init__(self, least: int, first: int):
        self.least, self.next = least, first
        self.small: dict[int, list[int]] = {}  # root: rows
        self.large: dict[int, int] = {}  # root: cluster
        self.mass: dict[int, list[float]] = {}  # cluster: sum of the densities at which its rows joined, their number
        self.joined: list[tuple[int, int, float]] = []
        self.ended: list[tuple[int, int, float, float, int]] = []

    def begin(self, root: int, mass: float, rows: int) -> int:
        self.next += 1
        self.large[root], self.mass[self.next] = self.next, [mass, rows]
        return self.next

    def join(self, cluster: int, rows: list[int], level: float, d: float) -> None:
        self.joined += [(r, cluster, level) for r in rows]
        m = self.mass[cluster]
        m[0] += d * len(rows)
        m[1] += len(rows)

    def merge(self, x: int, y: int, level: float, d: float) -> None:
        """Component x goes up in y."""
        a, b = self.large.pop(x, None), self.large.pop(y, None)
        if a is None and b is None:
            rows = self.small.pop(x) + self.small.pop(y)
            if len(rows) < self.least:
                self.small[y] = rows
            else:
                self.join(self.begin(y, 0.0, 0), rows, level, d)
        elif a is None or b is None:
            c = b if a is None else a
            self.large[y] = c
            self.join(c, self.small.pop(x if a is None else y), level, d)
        else:
            n = self.mass[a][1] + self.mass[b][1]
            p = self.begin(y, d * n, n)
            for c in (a, b):
                self.ended.append((c, p, level, *self.mass.pop(c)))


def run_band(forest: Forest, a: np.ndarray, b: np.ndarray, s: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Takes the edges of a band into the forest; (component, root) of all that the band touched."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)].tolist(), at[len(a) :].tolist()
    parent = list(range(len(names)))
    where = {int(n): k for k, n in enumerate(names.tolist())}
    forest.small, forest.large = {where[c]: r for c, r in forest.small.items()}, {where[c]: k for c, k in forest.large.items()}
    for c in names.tolist():
        if where[c] not in forest.small and where[c] not in forest.large:
            forest.small[where[c]] = [c]
    dens = density(s).tolist()
    level = s.tolist()
    for i in order(s, u, v).tolist():
        x, y = find(parent, a[i]), find(parent, b[i])
        if x != y:
            parent[x] = y
            forest.merge(x, y, level[i], dens[i])
    root = names[[find(parent, k) for k in range(len(names))]]
    forest.small, forest.large = {int(names[c]): r for c, r in forest.small.items()}, {int(names[c]): k for c, k in forest.large.items()}
    return names, root


#: What a band hands on. kind 0: row a joined cluster b at x; 1: cluster a ended in b at x, with mass y of n rows; 2: component a has the rows
#: listed, or is cluster b with mass y of n rows; 3: component a went up in b.
HANDED = "kind int, a long, b long, x double, y double, n long, rows binary"


def handed(forest: Forest, names: np.ndarray, root: np.ndarray) -> pa.Table:
    out: list[tuple] = [(0, r, c, x, 0.0, 0, None) for r, c, x in forest.joined] + [(1, c, p, x, m, int(n), None) for c, p, x, m, n in forest.ended]
    out += [(2, c, -1, 0.0, 0.0, len(r), np.array(r, np.int64).tobytes()) for c, r in forest.small.items()]
    out += [(2, c, k, 0.0, forest.mass[k][0], int(forest.mass[k][1]), None) for c, k in forest.large.items()]
    out += [(3, a, b, 0.0, 0.0, 0, None) for a, b in zip(names.tolist(), root.tolist())]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary())
    cols = list(zip(*out)) if out else [()] * 7
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "a", "b", "x", "y", "n", "rows"])


def condense(tree: DataFrame, least: int, floor: float, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """(joined, clusters) of the whole tree: (row, cluster, level) and (cluster, parent, level, mass, rows).

    The edges are taken from the most similar down, in bands of about ``band``; one task works through a band, with its
    edges between the components that the bands before it left. A parent of -1 means that a cluster lasts down to ``floor``.
    """
    spark = tree.sparkSession
    bands = max(1, -(-tree.count() // band))
    if bands > 1:
        tree = tree.repartitionByRange(bands, F.desc("s"), F.desc("u"), F.desc("v")).withColumn("band", F.spark_partition_id())
        tree = cut_lineage(tree)
    none = spark.createDataFrame([], HANDED)
    joined, ended, state, label = none, none, none, spark.createDataFrame([], "c long, root long")
    for i in range(bands):
        mine = tree.where(F.col("band") == i) if bands > 1 else tree
        if i:
            la, lb = label.select(F.col("c").alias("u"), F.col("root").alias("ra")), label.select(F.col("c").alias("v"), F.col("root").alias("rb"))
            mine = mine.join(la, "u", "left").join(lb, "v", "left")
        else:
            mine = mine.withColumn("ra", F.lit(None).cast("long")).withColumn("rb", F.lit(None).cast("long"))
        edges = cut_lineage(mine.select(F.coalesce("ra", "u").alias("a"), F.coalesce("rb", "v").alias("b"), "s", "u", "v"))
        touched = edges.select(F.explode(F.array("a", "b")).alias("a")).distinct()
        known = state.join(touched, "a", "left_semi")
        rows = edges.select(F.lit(9).alias("kind"), "a", "b", F.col("s").alias("x"), "u", "v", F.lit(0.0).alias("y"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("rows"))
        rows = rows.unionByName(known.select("kind", "a", "b", "x", F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), "y", "n", "rows"))

        def work(t: pa.Table) -> pa.Table:
            kind = t.column("kind").to_numpy()
            old, new = t.filter(pa.array(kind == 2)), t.filter(pa.array(kind == 9))
            forest = Forest(least, i << 40)
            for a, b, y, n, r in zip(*(old.column(c).to_pylist() for c in ("a", "b", "y", "n", "rows"))):
                if b < 0:
                    forest.small[a] = np.frombuffer(r, np.int64).tolist()
                else:
                    forest.large[a], forest.mass[b] = b, [y, n]
            return handed(forest, *run_band(forest, *(new.column(c).to_numpy() for c in ("a", "b", "x", "u", "v"))))

        out = cut_lineage(rows.groupBy(F.lit("").alias("all")).applyInArrow(work, HANDED))
        joined, ended = joined.unionByName(out.where("kind = 0")), ended.unionByName(out.where("kind = 1"))
        state = state.join(touched, "a", "left_anti").unionByName(out.where("kind = 2"))
        if i < bands - 1:
            moved = out.where("kind = 3").select(F.col("a").alias("c"), F.col("b").alias("root"))
            later = moved.select(F.col("c").alias("root"), F.col("root").alias("next"))
            label = cut_lineage(label.join(later, "root", "left").select("c", F.coalesce("next", "root").alias("root")).unionByName(moved.join(label.select("c"), "c", "left_anti")))
            state = cut_lineage(state)
    last = state.where("b >= 0").select("b", F.lit(-1).cast("long").alias("parent"), F.lit(float(floor)).alias("level"), "y", "n").toDF("cluster", "parent", "level", "mass", "rows")
    return joined.select(F.col("a").alias("row"), F.col("b").alias("cluster"), F.col("x").alias("level")), ended.select("a", "b", "x", "y", "n").toDF("cluster", "parent", "level", "mass", "rows").unionByName(last)


def select_stable(clusters: pa.Table, apart: float = 1.0) -> pa.Table:
    """(cluster, chosen): the cluster with the greatest stability above each (excess of mass), -1 where there is none.

    A cluster's stability is the sum, over its rows, of the density they are in it less that at which it ends. From the
    leaves up, a cluster is chosen where its own exceeds what its parts have together. Parts that meet at a similarity of
    ``apart`` or more are too close to be clusters of their own: what they form is one, with their stability.
    """
    name, parent, level, mass, rows = (clusters.column(c).to_numpy() for c in ("cluster", "parent", "level", "mass", "rows"))
    own = dict(zip(name.tolist(), (mass - rows * density(level)).tolist()))
    up, end = dict(zip(name.tolist(), parent.tolist())), dict(zip(name.tolist(), level.tolist()))
    parts: dict[int, float] = {}
    chosen: dict[int, bool] = {}
    for c in sorted(own):  # a parent begins after its parts
        chosen[c] = own[c] >= parts.get(c, 0.0)
        if up[c] >= 0 and end[c] >= apart:
            own[up[c]] += own[c]
        else:
            parts[up[c]] = parts.get(up[c], 0.0) + max(own[c], parts.get(c, 0.0))
    top: dict[int, int] = {}
    for c in sorted(own, reverse=True):
        above = top.get(up[c], -1) if up[c] >= 0 else -1
        top[c] = above if above >= 0 else c if chosen[c] and (up[c] < 0 or end[c] < apart) else -1
    return pa.table({"cluster": pa.array(list(top), pa.int64()), "chosen": pa.array(list(top.values()), pa.int64())})
