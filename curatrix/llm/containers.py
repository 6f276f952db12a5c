"""Filling containers of fixed capacity: bounded-space online best fit.

Each task reads its items once and holds a fixed number of open containers, found by their free space in a bitset. An
item goes where it leaves the least room; if it fits nowhere a container opens, for which the fullest closes if too
many are open. What is open at a task's end is packed again, container by container, with the rests of other tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.session import cut_lineage


class BestFit:
    """Open containers by free space; ``open_most`` at a time."""

    def __init__(self, capacity: int, open_most: int):
        self.capacity, self.open_most = capacity, open_most
        self.bits, self.at, self.count = 0, {}, 0

    def put(self, name: int, free: int) -> None:
        self.bits |= 1 << free
        self.at.setdefault(free, []).append(name)
        self.count += 1

    def take(self, free: int) -> int:
        names = self.at[free]
        name = names.pop()
        if not names:
            del self.at[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return name

    def place(self, size: int, fresh) -> int:
        """The container for an item of ``size``; ``fresh()`` names a new one."""
        fits = self.bits >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            name = self.take(free)
        else:
            if self.count >= self.open_most:
                self.take((self.bits & -self.bits).bit_length() - 1)
            name, free = fresh(), self.capacity
        if free > size:
            self.put(name, free - size)
        return name


def fill_containers(items: DataFrame, capacity: int, item: str = "doc_id", size: str = "tokens", open_most: int = 256, merge: int = 64) -> DataFrame:
    """(item, part, size, container): the container of each item, or of each part of one larger than ``capacity``.

    Parts count from 0; all but the last of a split item fill a container. Items of size null, zero or less need no
    room and come out with a null container. Repeated items are items each. ``open_most`` containers are open in a
    task; the rests of ``merge`` tasks meet in one. Column names of the items other than the two named don't matter.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = items.schema[item].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        fit, made = BestFit(capacity, open_most), 0

        def fresh() -> int:
            nonlocal made
            made += 1
            return task + made

        for b in batches:
            names, parts, sizes, boxes = [], [], [], []
            for name, n in zip(b.column("item").to_pylist(), b.column("size").to_pylist()):
                n, k = max(n or 0, 0), 0
                while n > capacity:
                    names.append(name), parts.append(k), sizes.append(capacity), boxes.append(fresh())
                    n, k = n - capacity, k + 1
                names.append(name), parts.append(k), sizes.append(n), boxes.append(fit.place(n, fresh) if n else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([False] * len(names)), pa.array(names, b.schema.field("item").type), pa.array(parts, pa.int32()), pa.array(sizes, pa.int64()), pa.array(boxes, pa.int64())],
                names=["rest", "item", "part", "size", "container"],
            )
            schema = b.schema
        rest = [(name, capacity - free) for free, names in fit.at.items() for name in names]
        if rest:
            yield pa.RecordBatch.from_arrays(
                [pa.array([True] * len(rest)), pa.nulls(len(rest), schema.field("item").type), pa.array([0] * len(rest), pa.int32()), pa.array([f for _, f in rest], pa.int64()), pa.array([n for n, _ in rest], pa.int64())],
                names=["rest", "item", "part", "size", "container"],
            )

    placed = cut_lineage(items.select(F.col(item).alias("item"), F.col(size).cast("long").alias("size")).mapInArrow(run, f"rest boolean, item {kind}, part int, size long, container long"))

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_most * merge)
        for b in batches:
            rows = sorted(zip(b.column("size").to_pylist(), b.column("container").to_pylist()), reverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([c for _, c in rows], pa.int64()), pa.array([fit.place(n, lambda c=c: c) for n, c in rows], pa.int64())], names=["container", "into"])

    rests = placed.where("rest").select("size", "container")
    groups = rests.withColumn("g", F.shiftright("container", 40) / merge).withColumn("g", F.col("g").cast("long"))
    into = groups.repartition("g").select("size", "container").mapInArrow(again, "container long, into long")
    return (
        placed.where("not rest")
        .join(into, "container", "left")
        .select(F.col("item").alias(item), "part", F.col("size").alias(size), F.coalesce("into", "container").alias("container"))
    )


def container_report(filled: DataFrame, capacity: int, item: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(containers, items, split_items, tokens, fill): how well the containers are filled."""
    per = filled.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum(size).alias("n"))
    boxes = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.max("n").alias("fullest"))
    rows = filled.agg(F.count_if(F.col("part") == 0).alias("items"), F.count_if(F.col("part") == 1).alias("split_items"))
    return boxes.crossJoin(rows).select("containers", "items", "split_items", "tokens", (F.col("tokens") / (F.col("containers") * F.lit(capacity))).alias("fill"), "fullest")
