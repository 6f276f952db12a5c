"""Most similar vectors for every vector: a permutation index.

A bounded sample of vectors serves as pivots. Each vector is represented by the order of its nearest pivots and is
posted in the inverted files of the first few of them. Within a file vectors are ranked against each other by the
footrule distance of their pivot orders, and the best are ranked again by cosine. The best of all files count.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.vectors import DIM, matrix, pack, pick_pivots, pivot_count, unit, unpack, usable_rows
from curatrix.operators.geometry import knn
from curatrix.session import cut_lineage

BLOCK = 1024
#: Cosines that a block of queries holds at most, and vectors that are compared pair by pair at once.
CELLS, PAIRS = 1 << 25, 1 << 16
#: Posted vectors of a partition (about 10 MB).
PART = 20_000
#: Pivots that a vector is compared with one by one; beyond, only with those under the nearest ``LEADS`` of some leading ones.
FLAT, LEADS = 4096, 16


class Pivots:
    """Unit vectors and the order in which they lie near a vector; of more than ``FLAT`` some lead the others."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.leads = np.zeros(0, int)
        if len(x) > FLAT:
            self.leads = np.arange(0, len(x), max(1, len(x) // math.ceil(2 * math.sqrt(len(x)))))
            nearest = np.concatenate([(x[s : s + 4096] @ x[self.leads].T).argmax(1) for s in range(0, len(x), 4096)])
            order = np.argsort(nearest, kind="stable")
            self.under = np.split(order, np.searchsorted(nearest[order], np.arange(1, len(self.leads))))

    def __len__(self) -> int:
        return len(self.x)

    def orders(self, x: np.ndarray, prefix: int) -> np.ndarray:
        """Numbers of the ``prefix`` nearest pivots of each unit row, nearest first."""
        if not len(self.leads):
            return orders(x, self.x, prefix)
        near = x @ self.x[self.leads].T
        near = np.argpartition(-near, LEADS - 1, axis=1)[:, :LEADS]
        rows, found, cos = [], [], []
        for g in np.unique(near):
            r = np.flatnonzero((near == g).any(1))
            s = x[r] @ self.x[self.under[g]].T
            k = min(prefix, s.shape[1])
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            rows.append(np.repeat(r, k)), found.append(self.under[g][best].ravel()), cos.append(np.take_along_axis(s, best, 1).ravel())
        rows, found, cos = np.concatenate(rows), np.concatenate(found), np.concatenate(cos)
        at = np.lexsort((-cos, rows))
        rows, found = rows[at], found[at]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(x)))[rows]
        width = int(min(prefix, np.bincount(rows).min()))
        return found[place < width].reshape(len(x), width).astype(np.uint16)


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the ``prefix`` nearest pivots of each unit row, nearest first."""
    s = x @ pivots.T
    k = min(prefix, s.shape[1])
    near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(k), (len(s), 1))
    rank = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
    return np.take_along_axis(near, rank, 1).astype(np.uint16)


def footrule_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half of what two pivot orders fall short of the greatest footrule distance l(l+1), for all rows of a against b.

    With a pivot outside the first l counted at rank l, the distance is l(l+1) less twice the sum, over the shared
    pivots, of l minus the later of the two ranks; so the greatest overlap is the smallest distance.
    """
    l = a.shape[1]
    out = np.zeros((len(a), len(b)), np.int16)
    rows, ranks = np.repeat(np.arange(len(b)), l), np.tile(np.arange(l), len(b))
    order = np.argsort(b.ravel(), kind="stable")
    names, starts = np.unique(b.ravel()[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    files = {int(p): (rows[order[s:e]], ranks[order[s:e]]) for p, s, e in zip(names, starts, ends)}
    qrows, qranks = np.repeat(np.arange(len(a)), l), np.tile(np.arange(l), len(a))
    qorder = np.argsort(a.ravel(), kind="stable")
    qnames, qstarts = np.unique(a.ravel()[qorder], return_index=True)
    for p, s, e in zip(qnames, qstarts, np.append(qstarts[1:], len(qorder))):
        if int(p) in files:
            r, k = files[int(p)]
            q, j = qrows[qorder[s:e]], qranks[qorder[s:e]]
            out[np.ix_(q, r)] += (l - np.maximum.outer(j, k)).astype(np.int16)
    return out


def search_file(ids: np.ndarray, x: np.ndarray, perm: np.ndarray, k: int, candidates: int | None, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, found row, cosine) of the k best of one inverted file, for each of its rows, in blocks of queries.

    Of a file with more rows than ``candidates`` only those with the smallest footrule distances are compared by cosine,
    with all that tie with the last of them.
    """
    qs, ds, cs = [], [], []
    n = len(ids)
    block = max(1, min(BLOCK, CELLS // max(n, 1)))
    for s in range(0, n, block):
        e = min(n, s + block)
        if candidates is not None and n > candidates:
            near = footrule_overlap(perm[s:e], perm)
            near[np.arange(e - s), np.arange(s, e)] = -1
            cut = np.partition(near, n - candidates, axis=1)[:, n - candidates]
            q, d = np.nonzero(near >= np.maximum(cut, 0)[:, None])
            cos = np.full((e - s, n), -2, np.float32)
            for t in range(0, len(q), PAIRS):
                i, j = q[t : t + PAIRS], d[t : t + PAIRS]
                cos[i, j] = np.einsum("ij,ij->i", x[s + i], x[j])
        else:
            cos = x[s:e] @ x.T
        cos[np.arange(e - s), np.arange(s, e)] = -2
        if least is not None:
            cos[cos < least] = -2
        # ties of the cosine go to the smaller id: rows come sorted by id
        if n > k:
            edge = np.partition(cos, n - k, axis=1)[:, n - k]
            q, d = np.nonzero((cos >= edge[:, None]) & (cos > -2))
        else:
            q, d = np.nonzero(cos > -2)
        c = cos[q, d]
        order = np.lexsort((d, -c, q))
        q, d, c = q[order], d[order], c[order]
        first = np.searchsorted(q, np.arange(e - s))
        keep = np.arange(len(q)) - first[q] < k
        qs.append(q[keep] + s), ds.append(d[keep]), cs.append(c[keep])
    return (np.concatenate(qs), np.concatenate(ds), np.concatenate(cs)) if qs else (np.zeros(0, int),) * 3


def short_ids(ids: list[str]) -> pa.Array:
    """Ids as bytes: hexadecimal ones take half their length, any others theirs; a first byte tells them apart."""

    def short(i: str) -> bytes:
        try:
            b = bytes.fromhex(i)
        except ValueError:
            return b"\0" + i.encode()
        return b"\1" + b if b.hex() == i else b"\0" + i.encode()

    return pa.array([short(i) for i in ids], pa.binary())


def long_ids(ids: list[bytes]) -> list[str]:
    """The ids that :func:`short_ids` shortened."""
    return [i[1:].hex() if i[0] else i[1:].decode() for i in ids]


def post(vectors: DataFrame, pivots: np.ndarray, posts: int, prefix: int, dim: int, rows: int) -> DataFrame:
    """(file, id, vec, perm): each vector in the inverted files of its ``posts`` nearest pivots, with its pivot order; see :func:`short_ids`.

    The files are spread over partitions of about ``PART`` of the ``rows`` times ``posts`` rows, at least as many as the
    session's.
    """
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(Pivots(pivots))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * posts // PART))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = matrix(batch.column("vec"), dim)
            perm = sent.value.orders(unit(raw), prefix)
            ids, vecs, perms = short_ids(batch.column("id").to_pylist()), pa.array(pack(raw), pa.binary()), pa.array([r.tobytes() for r in perm], pa.binary())
            for t in range(min(posts, perm.shape[1])):
                yield pa.RecordBatch.from_arrays([pa.array(perm[:, t].astype(np.int32)), ids, vecs, perms], names=["file", "id", "vec", "perm"])

    return vectors.select("id", "vec").mapInArrow(run, "file int, id binary, vec binary, perm binary").repartition(parts, "file")


def posts_for(rows: int, least: int = 5) -> int:
    """Inverted files a vector is posted in so that recall holds as ``rows`` grow: one more for ten times the rows."""
    return max(least, math.ceil(math.log10(max(rows, 1))))


def crowded_copies(vectors: DataFrame, rows: int, least: int = 1000, share: int = 1000) -> DataFrame:
    """(h): the vectors, by hash, found more than ``least`` times and in more than a ``share``-th of ``rows``; so at most ``share`` rows."""
    per = vectors.groupBy(F.xxhash64("vec").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per.where(F.col("n") > max(least, rows // share)).select("h")


def permutation_neighbours(
    df: DataFrame,
    k: int = 5,
    id_col: str = "id",
    vec_col: str = "embedding",
    dim: int = DIM,
    least_cosine: float | None = None,
    pivots: int | None = None,
    posts: int | None = 3,
    prefix: int = 16,
    candidates: int | None = 48,
    seed: int = 0,
) -> DataFrame:
    """(id, neighbour, cosine): for each id with a usable vector its ``k`` most similar other ids.

    Parameters: ``pivots`` (:func:`pivot_count` unless given), ``posts`` inverted files a
    vector is posted in (None: :func:`posts_for`), ``prefix`` pivots of its order, ``candidates`` kept by footrule in a
    file before cosines count (None: the whole file), ``least_cosine`` to leave out
    weaker neighbours early. Approximate: a neighbour is found if it shares one of its nearest pivots. An id whose files
    hold fewer than ``k`` others is held against all rows, unless ``least_cosine`` is given; so it has fewer only where
    there are no more.

    Null ids and unusable vectors (null, other length, NaN, infinite or null values, all zero) neither ask nor answer.
    Repeated rows of an id count once; where they hold different vectors, each is searched and the best cosine counts.
    Equal cosines go to the smaller id. A vector that more than a thousandth of all rows (and over 1,000) share never
    gathers in one file: six of its smallest ids are posted for all, and its further ids get the five smallest.
    Empty input gives an empty result. Other columns are ignored.
    """
    spark = df.sparkSession
    vectors = usable_rows(df, id_col, vec_col, dim)
    count = df.select(id_col).count()
    posts = posts_for(count) if posts is None else posts
    prefix = max(prefix, posts)
    piv = pick_pivots(vectors, pivots or pivot_count(count), count, seed)
    if not len(piv):
        return spark.createDataFrame([], "id string, neighbour string, cosine double")
    hot = [r.h for r in crowded_copies(vectors, count).collect()]
    extra = None
    if hot:
        marked = vectors.withColumn("h", F.xxhash64("vec"))
        copies = cut_lineage(marked.where(F.col("h").isin(hot)).select("h", "id").distinct())
        firsts = smallest_ids(copies, k + 1)
        extra = (
            copies.join(F.broadcast(firsts), "h")
            .select("id", F.explode(F.slice(F.filter("firsts", lambda x: x != F.col("id")), 1, k)).alias("neighbour"))
            .withColumn("cosine", F.lit(1.0))
        )
        vectors = marked.join(F.broadcast(firsts), "h", "left").where(F.col("firsts").isNull() | F.array_contains("firsts", F.col("id"))).select("id", "vec")
    cells = post(vectors, piv, posts, prefix, dim, count)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        file = table.column("file")[0].as_py()
        ids = np.array(long_ids(table.column("id").to_pylist()), dtype=object)
        key = np.array([f"{i}\0{v!r}" for i, v in zip(ids, table.column("vec").to_pylist())], dtype=object) if len(set(ids)) < len(ids) else ids
        at = np.unique(key, return_index=True)[1]
        at = at[np.argsort(ids[at], kind="stable")]
        part = table.take(pa.array(at))
        x = unit(unpack(part.column("vec").combine_chunks(), dim))
        perm = np.frombuffer(b"".join(part.column("perm").to_pylist()), np.uint16).reshape(len(at), -1)
        names = ids[at]
        q, d, c = search_file(names, x, perm, k + int(len(key) != len(at)), candidates, least_cosine)
        # a pair that meets in several files counts in the first that both are posted in
        both = (perm[q][:, :posts, None] == perm[d][:, None, :posts]).any(2)
        first = perm[q][np.arange(len(q)), both.argmax(1)] == file
        keep = first & (names[q] != names[d])
        return pa.table({"id": pa.array(names[q][keep], pa.string()), "neighbour": pa.array(names[d][keep], pa.string()), "cosine": pa.array(np.round(c[keep].astype(float), 6), pa.float64())})

    found = cells.groupBy("file").applyInArrow(run, "id string, neighbour string, cosine double")
    if extra is not None:
        found = found.unionByName(extra)
    # at most posts * k (and k for copies) rows an id: a bounded array
    ranked = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "neighbour"))).alias("all"))
    once = F.filter("all", lambda x, i: F.array_position(F.col("all.neighbour"), x["neighbour"]) == i + 1)
    near = ranked.select("id", F.explode(F.slice(once, 1, k)).alias("n")).select("id", "n.neighbour", (-F.col("n.d")).alias("cosine"))
    return near if least_cosine is not None else completed(near, usable_rows(df, id_col, vec_col, dim), k)


def completed(near: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``near`` with all ``k`` neighbours of those ids whose files hold too few: these, few by nature, are held against all rows in blocks."""
    near = cut_lineage(near)
    have = near.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("id")
    short = cut_lineage(vectors.join(have, "id", "left_anti").groupBy("id").agg(F.min("vec").alias("vec")))
    if not short.limit(1).count():
        return near
    once = vectors.groupBy("id").agg(F.min("vec").alias("vec"))
    found = knn(once, short, k, "id", "vec").select(F.col("query").alias("id"), "neighbour", "cosine")
    return near.join(short.select("id"), "id", "left_anti").unionByName(found)


def smallest_ids(copies: DataFrame, k: int) -> DataFrame:
    """(h, firsts): the ``k`` smallest ids of each h, reduced within salted parts before they meet."""

    def least(rows: DataFrame, *keys: str) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy(*keys).orderBy("id")
        return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")

    salted = least(copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256))), "h", "salt").drop("salt")
    return least(salted, "h").groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("firsts"))
