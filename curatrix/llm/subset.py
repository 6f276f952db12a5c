"""Choosing a varied subset: tournament-pivoted rank-revealing QR in deflated rounds.

In a round each task nominates linearly independent rows by pivoted QR; nominations meet in pairs and are pivoted
again until one set is left. Then all rows are deflated: the directions of what is chosen are taken out of them, and rows
that nearly say the same as a chosen one weigh little. When the directions are used up, they come in again, and rounds
go on with the rows that are unlike all chosen ones until the subset is full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.neighbours import long_ids, short_ids
from curatrix.llm.vectors import DIM, matrix, pack, unit, unpack, usable_rows
from curatrix.session import cut_lineage

SCHEMA = "slot int, id binary, vec binary, rest binary"


def pivoted(x: np.ndarray, most: int, rank: float = 0.05) -> np.ndarray:
    """The rows that QR with column pivoting of x' picks first, at most ``most``; it stops where the rest falls below ``rank``.

    Ties go to the first row.
    """
    n = len(x)
    rest = np.einsum("ij,ij->i", x, x)
    q = np.zeros((min(most, x.shape[1], n), x.shape[1]), np.float32)
    picked: list[int] = []
    for k in range(len(q)):
        i = int(rest.argmax())
        if rest[i] < rank * rank:
            break
        v = x[i].astype(np.float64)
        for _ in range(2):  # twice is enough
            v -= q[:k].T @ (q[:k] @ v)
        size = np.linalg.norm(v)
        if size < rank / 2:
            rest[i] = 0
            continue
        q[k] = v / size
        rest = np.maximum(rest - (x @ q[k]) ** 2, 0)
        rest[i] = -1
        picked.append(i)
    return np.array(picked, int)


def deflated(x: np.ndarray, chosen: np.ndarray, basis: np.ndarray, likeness: float) -> np.ndarray:
    """What is left of unit rows without the directions in ``basis`` (orthonormal), scaled by what their most similar chosen row leaves over; none where they are alike."""
    if not len(chosen):
        return x
    top = np.maximum((x @ chosen.T).max(1), 0)
    y = x - (x @ basis.T) @ basis if len(basis) else x
    return y * np.where(top >= likeness, 0, np.sqrt(np.maximum(1 - top**2, 0)))[:, None]


def varied_subset(df: DataFrame, size: int, id_col: str = "id", vec_col: str = "embedding", dim: int = DIM, width: int = 64, likeness: float = 0.8, block: int = 4096) -> DataFrame:
    """(id, rank, round) of ``size`` varied ids, in the order in which they were chosen.

    A round adds at most ``width`` rows; rows at a cosine of ``likeness`` or more to a chosen one are left for when
    nothing else is. The subset, which the caller bounds, is held on the driver; the packed vectors are written once and
    read once a round. At a meeting two sets of at most ``width`` nominations are in one place. As in any tournament the
    choice depends on which rows meet, that is on how the table is divided.

    Unusable vectors and null ids are never chosen and repeated rows of an id are one. If there are fewer than ``size``
    distinct directions, near copies fill the rest in the order of their ids; if there are fewer ids, all come out.
    Ties go to the smaller id within a block of rows. Empty input gives an empty result.
    """
    spark = df.sparkSession

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([short_ids(b.column("id").to_pylist()), pa.array(pack(matrix(b.column("vec"), dim)), pa.binary())], names=["id", "vec"])

    vectors = cut_lineage(usable_rows(df, id_col, vec_col, dim).mapInArrow(packed, "id binary, vec binary"))
    tasks = vectors.rdd.getNumPartitions()
    ids: list[str] = []
    rounds: list[int] = []
    chosen = basis = np.zeros((0, dim), np.float32)
    turn = 0
    while len(ids) < size:
        turn += 1
        want = min(width, size - len(ids))
        if len(basis) + want > dim:
            basis = basis[:0]
        sent = spark.sparkContext.broadcast((chosen, basis, frozenset(short_ids(ids).to_pylist())))

        def best(names: np.ndarray, x: np.ndarray, y: np.ndarray, want: int = want) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.argsort(names, kind="stable")
            order = order[np.unique(names[order], return_index=True)[1]]
            keep = order[pivoted(y[order], want)]
            return names[keep], x[keep], y[keep]

        def nominate(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, directions, taken = sent.value
            names, x, y = np.zeros(0, object), np.zeros((0, dim), np.float32), np.zeros((0, dim), np.float32)
            for b in batches:
                got = np.array(b.column("id").to_pylist(), dtype=object)
                raw = unit(unpack(b.column("vec"), dim)) if b.num_rows else np.zeros((0, dim), np.float32)
                left = deflated(raw, known, directions, likeness)
                new = np.flatnonzero(left.any(1) & np.array([i not in taken for i in got], bool)) if len(got) else np.zeros(0, int)
                for s in range(0, len(new), block):
                    part = new[s : s + block]
                    names, x, y = best(np.concatenate([names, got[part]]), np.concatenate([x, raw[part]]), np.concatenate([y, left[part]]))
            if len(names):
                yield batch(TaskContext.get().partitionId(), names, x, y)

        def batch(slot: int, names: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            rows = lambda m: pa.array([r.tobytes() for r in m.astype(np.float32)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([slot] * len(names), pa.int32()), pa.array(names.tolist(), pa.binary()), rows(x), rows(y)], names=["slot", "id", "vec", "rest"])

        def meet(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            x, y = (unpack(table.column(c).combine_chunks(), dim) for c in ("vec", "rest"))
            return pa.Table.from_batches([batch(table.column("slot")[0].as_py(), *best(np.array(table.column("id").to_pylist(), dtype=object), x, y))])

        level, sets = vectors.mapInArrow(nominate, SCHEMA), tasks
        while sets > 1:  # two sets meet, whatever the number of tasks
            level = level.withColumn("slot", F.floor(F.col("slot") / 2).cast("int")).groupBy("slot").applyInArrow(meet, SCHEMA)
            sets = (sets + 1) // 2
        got = level.toArrow()
        if not got.num_rows:
            if not len(basis):
                break
            basis, turn = basis[:0], turn - 1  # nothing is left without the directions: they come in again
            continue
        ids += long_ids(got.column("id").to_pylist())
        rounds += [turn] * got.num_rows
        chosen = np.concatenate([chosen, unpack(got.column("vec").combine_chunks(), dim)])
        basis = np.linalg.qr(np.concatenate([basis, chosen[-got.num_rows :]]).T.astype(np.float64))[0].T.astype(np.float32)
    if len(ids) < size:
        taken = short_ids(ids).to_pylist()
        more = vectors.select("id").distinct().where(~F.col("id").isin(taken)) if ids else vectors.select("id").distinct()
        extra = long_ids([bytes(r.id) for r in more.orderBy("id").limit(size - len(ids)).collect()])
        ids, rounds = ids + extra, rounds + [turn] * len(extra)
    return spark.createDataFrame([(i, k, r) for k, (i, r) in enumerate(zip(ids, rounds), 1)], "id string, rank int, round int")
