"""Grouping vectors into similarity clusters: hierarchical density clustering.

1. Each vector goes to the cells of its nearest pivots (a bounded sample that follows the density). In a cell, near
   copies count once for the density; the core similarity of a vector is that of its ``neighbours``-th distinct
   neighbour, and the mutual reachability of two vectors the least of both cores and their cosine. A spanning tree of
   each cell holds all that the cell can add to the spanning tree of the whole.
2. Boruvka rounds join the trees of all cells to the spanning tree of the whole.
3. The whole tree is condensed: components below the least size are rows that join or leave a cluster; and the clusters
   with the greatest stability (excess of mass) are chosen.
4. The chosen clusters are checked: those of which one holds a row within ``other`` of the mean direction of another are
   one, and rows further than ``own`` from the mean direction of their cluster are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.neighbours import long_ids, post
from curatrix.llm.tree import condense, select_stable, spanning_tree
from curatrix.llm.vectors import DIM, matrix, pick_pivots, pivot_count, unit, unpack, usable_rows
from curatrix.session import cut_lineage

#: Rows of a cell up to which all its similarities are held at once; those of a larger cell are computed row by row.
CELL, BLOCK = 3072, 256
NEVER = -2.0
#: Mean directions that rows are compared with at once (8 MB), and labels that are sent to all executors (32 MB).
MEANS, LABELS = 8192, 2_000_000


def leaders(x: np.ndarray, copies: float) -> np.ndarray:
    """For each row the first row within ``copies`` of it that follows no other itself."""
    n = len(x)
    leader = np.full(n, -1)
    for s in range(0, n, BLOCK):
        sim = x[s : s + BLOCK] @ x.T
        for i in range(s, min(n, s + BLOCK)):
            if leader[i] < 0:
                mine = (sim[i - s] >= copies) & (leader < 0)
                mine[i] = True
                leader[mine] = i
    return leader


def cell_tree(x: np.ndarray, neighbours: int, copies: float, least_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, mutual reachability) of a greatest spanning tree of unit rows.

    Rows within ``copies`` of an earlier leader hang on to it at its core similarity and don't count as neighbours; but
    ``least_size`` of them or more are dense by themselves and hang on at their likeness.
    """
    n = len(x)
    leader = leaders(x, copies)
    heads = np.flatnonzero(leader == np.arange(n))
    y, h = x[heads], len(heads)
    whole = y @ y.T if h <= CELL else None
    k = min(neighbours, h - 1)
    core_h = np.full(h, NEVER, np.float32)
    if k == neighbours:
        for s in range(0, h, BLOCK):
            sim = whole[s : s + BLOCK].copy() if whole is not None else y[s : s + BLOCK] @ y.T
            sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = NEVER
            core_h[s : s + BLOCK] = np.partition(sim, h - k, axis=1)[:, h - k]
    many = np.bincount(leader, minlength=n)[leader] >= least_size
    rest = np.flatnonzero(leader != np.arange(n))
    core = np.zeros(n, np.float32)
    core[heads] = core_h
    hang = core[leader[rest]]
    hang = np.where(many[rest], np.maximum(hang, np.einsum("ij,ij->i", x[rest], x[leader[rest]])), hang)
    us, vs, ws = [rest], [leader[rest]], [hang]
    if h > 1:
        best, to = np.full(h, -9, np.float32), np.zeros(h, int)
        done = np.zeros(h, bool)
        a, b, w = np.empty(h - 1, int), np.empty(h - 1, int), np.empty(h - 1, np.float32)
        i = 0
        for t in range(h - 1):
            done[i], best[i] = True, -9
            reach = np.minimum(np.minimum(whole[i] if whole is not None else y @ y[i], core_h[i]), core_h)
            better = (reach > best) & ~done
            best[better], to[better] = reach[better], i
            i = int(best.argmax())
            a[t], b[t], w[t] = i, to[i], best[i]
        us.append(heads[a]), vs.append(heads[b]), ws.append(w)
    return np.concatenate(us), np.concatenate(vs), np.concatenate(ws)


def reachability_edges(cells: DataFrame, neighbours: int, copies: float, least_size: int, floor: float, dim: int) -> DataFrame:
    """(u, v, s) by node number: the spanning trees of all cells, down to ``floor``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = np.array([int(i, 16) for i in long_ids(table.column("id").to_pylist())], np.uint64).astype(np.int64)
        node, at = np.unique(node, return_index=True)
        u, v, w = cell_tree(unit(unpack(table.column("vec").take(pa.array(at)).combine_chunks(), dim)), neighbours, copies, least_size)
        keep = w >= floor
        return pa.table({"u": pa.array(node[u[keep]]), "v": pa.array(node[v[keep]]), "s": pa.array(w[keep].astype(np.float64))})

    return cells.groupBy("file").applyInArrow(run, "u long, v long, s double")


def density_clusters(
    df: DataFrame,
    id_col: str = "id",
    vec_col: str = "embedding",
    dim: int = DIM,
    least_size: int = 10,
    own: float = 0.45,
    other: float = 0.4,
    neighbours: int = 3,
    copies: float = 0.8,
    floor: float | None = None,
    posts: int = 3,
    pivots: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """(id, cluster, own_cosine, persistence) of the members of all clusters; :func:`describe` sums the clusters up.

    The clusters are the most stable ones of the condensed hierarchy down to ``floor``; unless given that is ``own``
    squared, which is how alike rows are that have a cosine of ``own`` to one direction. Parts that meet at ``other`` or
    more aren't apart. A cluster has ``least_size`` ids or more, each with a cosine of ``own`` or more to its mean
    direction, and none has ``other`` or more to that of another (:func:`checked`). ``persistence`` is the similarity down
    to which a member stays in the tree.

    Ids that belong to no cluster don't come out. Unusable vectors and null ids are left out, repeated rows of an id
    count once, exact copies are members like any others. Empty input gives empty results.
    """
    spark = df.sparkSession
    rows = df.select(id_col).count()
    vectors = usable_rows(df, id_col, vec_col, dim)
    piv = pick_pivots(vectors, pivots or pivot_count(rows), rows, seed)
    if not len(piv):
        return spark.createDataFrame([], "id string, cluster long, own_cosine double, persistence double")
    floor = own * own if floor is None else floor
    numbered = vectors.select(F.lower(F.lpad(F.hex(F.xxhash64("id")), 16, "0")).alias("id"), "vec")
    edges = reachability_edges(post(numbered, piv, posts, posts, dim, rows), neighbours, copies, least_size, floor, dim)
    joined, clusters = condense(spanning_tree(edges), least_size, floor)
    chosen = clusters.groupBy(F.lit("").alias("all")).applyInArrow(lambda t: select_stable(t, other), "cluster long, chosen long")
    labels = cut_lineage(joined.join(chosen, "cluster").where("chosen >= 0").select(F.col("row").alias("node"), F.col("chosen").alias("cluster"), F.col("level").alias("persistence")))
    return checked(vectors, labels, least_size, own, other, dim)


def mean_directions(members: DataFrame, dim: int) -> DataFrame:
    """(cluster, n, mean) of the rows (cluster, vec), added up in each task before they meet."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, c = unit(matrix(b.column("vec"), dim)), b.column("cluster").to_numpy()
                order = np.argsort(c, kind="stable")
                names, starts = np.unique(c[order], return_index=True)
                sums = np.add.reduceat(x[order].astype(np.float64), starts, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.diff(np.append(starts, len(c)))), pa.array([r.tobytes() for r in sums], pa.binary())], names=["cluster", "n", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.frombuffer(b"".join(table.column("part").to_pylist()), np.float64).reshape(-1, dim).sum(0, keepdims=True)
        return pa.table({"cluster": table.column("cluster").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "mean": pa.array([unit(total.astype(np.float32)).tobytes()], pa.binary())})

    # a task sends one row a cluster and batch, so that what meets follows the batches, not the rows
    return members.select("cluster", "vec").mapInArrow(partial, "cluster long, n long, part binary").groupBy("cluster").applyInArrow(add, "cluster long, n long, mean binary")


def checked(vectors: DataFrame, labels: DataFrame, least_size: int, own: float, other: float, dim: int) -> DataFrame:
    """(id, cluster, own_cosine, persistence) of the labels (node, cluster, persistence) that hold.

    Clusters of which one has a row with a cosine of ``other`` or more to the mean direction of another are joined, until
    there are none. Then rows below ``own`` to the mean direction of their cluster go, and clusters that are left with
    fewer than ``least_size`` ids. Means are compared in blocks of ``MEANS``.
    """
    spark = vectors.sparkSession
    while True:
        small = labels.count() <= LABELS
        members = vectors.withColumn("node", F.xxhash64("id")).join(F.broadcast(labels) if small else labels, "node")
        means = cut_lineage(mean_directions(members, dim))
        names = np.sort(means.select("cluster").toArrow().column("cluster").to_numpy())  # one number a cluster
        met: set[tuple[int, int]] = set()
        near = None
        for s in range(0, len(names), MEANS):
            block = means.where(F.col("cluster").between(int(names[s]), int(names[min(len(names), s + MEANS) - 1]))).toArrow()
            sent = spark.sparkContext.broadcast((block.column("cluster").to_numpy(), np.frombuffer(b"".join(block.column("mean").to_pylist()), np.float32).reshape(-1, dim)))

            def compare(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                at, m = sent.value
                seen: set[tuple[int, int]] = set()
                for b in batches:
                    if b.num_rows:
                        c = b.column("cluster").to_numpy()
                        cos = unit(matrix(b.column("vec"), dim)) @ m.T
                        mine = c[:, None] == at[None, :]
                        q, j = np.nonzero((cos >= other) & ~mine)
                        new = set(zip(c[q].tolist(), at[j].tolist())) - seen
                        seen |= new
                        q, j = np.nonzero(mine)
                        keep = pa.array(q)
                        k, n = len(q), len(new)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(b.column("id").take(keep).to_pylist() + [None] * n, pa.string()),
                                pa.array(c[q].tolist() + [a for a, _ in new], pa.int64()),
                                pa.array([None] * k + [o for _, o in new], pa.int64()),
                                pa.array(cos[q, j].astype(float).tolist() + [None] * n, pa.float64()),
                                pa.array(b.column("persistence").take(keep).to_pylist() + [None] * n, pa.float64()),
                            ],
                            names=["id", "cluster", "met", "cosine", "persistence"],
                        )

            found = members.select("id", "vec", "cluster", "persistence").mapInArrow(compare, "id string, cluster long, met long, cosine double, persistence double")
            near = found if near is None else near.unionByName(found)
        if near is None:
            return spark.createDataFrame([], "id string, cluster long, own_cosine double, persistence double")
        near = cut_lineage(near)
        met = [(r.cluster, r.met) for r in near.where("met is not null").select("cluster", "met").distinct().orderBy("cluster", "met").collect()]  # pairs of clusters, not of rows
        if not met:
            break
        group = dict(zip(names.tolist(), names.tolist()))

        def top(c: int) -> int:
            while group[c] != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        for a, b in met:
            group[max(top(a), top(b))] = min(top(a), top(b))
        moves = spark.createDataFrame([(c, top(c)) for c in group if top(c) != c], "cluster long, into long")
        labels = cut_lineage(labels.join(F.broadcast(moves), "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster"), "persistence"))
    # of repeated rows of an id the nearer one counts
    held = near.where(F.col("cosine") >= own).groupBy("id").agg(F.max(F.struct("cosine", "cluster", "persistence")).alias("m")).select("id", "m.cluster", F.round("m.cosine", 6).alias("own_cosine"), "m.persistence")
    large = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_size).select("cluster")
    return cut_lineage(held).join(F.broadcast(cut_lineage(large)), "cluster", "left_semi").select("id", "cluster", "own_cosine", "persistence")


def describe(members: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster, size, typical): the size of each cluster and its most persistent members."""
    part = F.pmod(F.xxhash64("id"), F.lit(64))  # a cluster of any size is ranked in parts first
    rank = lambda *keys: F.row_number().over(Window.partitionBy("cluster", *keys).orderBy(F.desc("persistence"), "id"))
    first = members.withColumn("part", part).withColumn("r", rank("part")).where(F.col("r") <= typical)
    first = first.withColumn("r", rank()).where(F.col("r") <= typical)
    names = first.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("t")).select("cluster", F.col("t.id").alias("typical"))
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(names, "cluster").select("cluster", "size", "typical")


def consecutive(members: DataFrame, partitions: int) -> DataFrame:
    """(id_a, id_b): ids that follow each other in the sorted list of their cluster.

    The rows are sorted by range, so a cluster of any size spreads over tasks; only the first and last row of each
    partition meet in one place.
    """

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "cluster", "id_a", "id_b"]
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cluster, ids = b.column("cluster").to_pylist(), b.column("id").to_pylist()
            if last is None:
                yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([cluster[0]]), pa.array([ids[0]]), pa.array([None], pa.string())], names=names)
            else:
                cluster, ids = [last[0], *cluster], [last[1], *ids]
            keep = [k for k in range(len(ids) - 1) if cluster[k] == cluster[k + 1] and ids[k] != ids[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(keep), pa.int64()), pa.array([cluster[k] for k in keep], pa.int64()), pa.array([ids[k] for k in keep], pa.string()), pa.array([ids[k + 1] for k in keep], pa.string())], names=names)
            last = cluster[-1], ids[-1]
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([2]), pa.array([last[0]]), pa.array([last[1]]), pa.array([None], pa.string())], names=names)

    ordered = members.select("cluster", "id").repartitionByRange(partitions, "cluster", "id").sortWithinPartitions("cluster", "id")
    found = cut_lineage(ordered.mapInArrow(pairs, "kind long, cluster long, id_a string, id_b string"))
    w = Window.partitionBy("cluster").orderBy("id_a", "kind")  # two rows a partition
    seams = found.where("kind > 0").withColumn("id_b", F.lead("id_a").over(w)).withColumn("next", F.lead("kind").over(w)).where("kind = 2 and next = 1 and id_a <> id_b")
    return found.where("kind = 0").select("id_a", "id_b").unionByName(seams.select("id_a", "id_b"))
