"""A sample whose shares match target proportions: swap repair on counts of category signatures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.tokens import label
from curatrix.session import cut_lineage

CATEGORIES = ("dataset", "meta_domain", "meta_difficulty_bin")


def signed(df: DataFrame, categories: tuple[str, ...] = CATEGORIES, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, *categories): the ids with a non-null text, once each, with labels brought to one spelling; of several labels of an id the smallest count."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.struct(*[label(c).alias(c) for c in categories]).alias("s"))
    return rows.groupBy("id").agg(F.min("s").alias("s")).select("id", "s.*")


def swap_repair(start: np.ndarray, supply: np.ndarray, floor: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Counts after exchanging records between signatures while the sum of squared deviations from ``goal`` falls.

    Records move from the signature furthest above its goal to the one furthest below, as many at once as still help;
    no count leaves [floor, supply] and the total stays.
    """
    n = start.astype(np.int64).copy()
    while True:
        over = np.where(n > floor, n - goal, -np.inf)
        under = np.where(n < supply, goal - n, -np.inf)
        a, b = int(over.argmax()), int(under.argmax())
        # moving m lowers the squares while m < over + under
        gain = over[a] + under[b]
        if a == b or not np.isfinite(gain) or gain <= 1:
            return n
        m = int(min(max(1, gain // 2), n[a] - floor[a], supply[b] - n[b]))
        n[a], n[b] = n[a] - m, n[b] + m


def plan(supply: np.ndarray, share: np.ndarray, least: np.ndarray, rows: int, seed: int = 0) -> np.ndarray:
    """Records to draw from each signature: a random start that satisfies the floors, then swap repair.

    The total is ``rows``, or all there are; if the floors alone exceed it, they come first and the total is theirs.
    """
    floor = np.minimum(least, supply)
    rest = supply - floor
    more = int(min(max(rows - floor.sum(), 0), rest.sum()))
    rng = np.random.default_rng(seed)
    n = floor.copy()
    left = rest.copy()
    while more > 0:
        draw = np.minimum(rng.multinomial(more, left / left.sum()), left)
        n, left, more = n + draw, left - draw, more - int(draw.sum())
    return swap_repair(n, supply, floor, np.maximum(share * rows, least))


def target_plan(records: DataFrame, targets: DataFrame, categories: tuple[str, ...] = CATEGORIES, seed: int = 0) -> DataFrame:
    """(target_id, *categories, target_share, min_rows, need, supply, drawn, short, unmet) of each target.

    ``need`` is the larger of the minimum and the share of the sample; ``short`` where it exceeds the supply. ``unmet``
    tells why the repaired plan draws less than the target needs: ``supply`` where there are no more records, ``total``
    where there are, but the minimums of others leave no place in the sample; null where it is met. A null
    category of a target is a category of its own; two targets of one category get its records in turn, by target_id.
    The table of targets is small by nature and is planned on the driver; the records aren't gathered.
    """
    spark = records.sparkSession
    keys = [label(c).alias(c) for c in categories]
    t = targets.where(F.col("target_id").isNotNull()).select("target_id", *keys, F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), F.coalesce("sample_rows", F.lit(0)).alias("sample_rows")).dropDuplicates(["target_id"])
    supply = records.groupBy(*categories).agg(F.count(F.lit(1)).alias("supply"))
    same = [t[c].eqNullSafe(supply[c]) for c in categories]
    on = same[0]
    for s in same[1:]:
        on = on & s
    got = t.join(supply, on, "left").select("target_id", *[t[c] for c in categories], "target_share", "min_rows", "sample_rows", F.coalesce("supply", F.lit(0)).alias("supply")).orderBy("target_id").toPandas()
    schema = t.select(*categories).schema
    out = "target_id long, " + ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in categories) + ", target_share double, min_rows long, need double, supply long, drawn long, short boolean, unmet string"
    if got.empty:
        return spark.createDataFrame([], out)
    rows = int(got["sample_rows"].max())
    have, least, share = (got[c].to_numpy() for c in ("supply", "min_rows", "target_share"))
    key = got[list(categories)].astype(object).where(got[list(categories)].notna(), None).apply(tuple, axis=1)
    own = have.copy()
    for k in set(key[key.duplicated()]):  # targets of one category share its supply
        left = int(have[np.flatnonzero(key == k)[0]])
        for i in np.flatnonzero(key == k):
            own[i] = min(left, int(np.ceil(max(least[i], share[i] * rows))))
            left -= own[i]
        own[np.flatnonzero(key == k)[-1]] += left
    drawn = plan(own, share, least, rows, seed)
    need = np.maximum(least, share * rows)
    data = [(int(i), *k, float(s), int(m), float(d), int(h), int(n), bool(d > h), "supply" if d > h and n >= h else "total" if n < int(d + 1e-9) else None) for i, k, s, m, d, h, n in zip(got["target_id"], key, share, least, need, have, drawn)]
    return spark.createDataFrame(data, out)


def proportional_sample(records: DataFrame, planned: DataFrame, categories: tuple[str, ...] = CATEGORIES, seed: int = 0, parts: int = 4096) -> DataFrame:
    """(target_id, id): the records of the plan, drawn at random by the hash of the id.

    The hash cuts each category into ``parts``; counting them shows in which part the last record to draw lies, and
    the parts up to it are ranked each by itself, so no category is sorted as a whole.
    """
    h = F.xxhash64("id", F.lit(seed))
    small = F.broadcast(planned.select("target_id", F.struct(*categories).alias("key"), "drawn"))
    # targets of one category: the first takes its records, the next the following ones
    w = Window.partitionBy("key").orderBy("target_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = cut_lineage(small.withColumn("to", F.sum("drawn").over(w)).withColumn("from", F.col("to") - F.col("drawn")))
    last = spans.groupBy("key").agg(F.max("to").alias("last"))
    rows = records.select("id", F.struct(*categories).alias("key"), h.alias("h")).withColumn("part", F.shiftrightunsigned("h", 52) % parts)
    lasts = last.select(F.col("key").alias("last_key"), "last")
    mine = rows.join(F.broadcast(lasts), F.col("key").eqNullSafe(F.col("last_key"))).drop("last_key")
    sizes = mine.groupBy("key", "part", "last").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).where(F.col("before") < F.col("last")).select(F.col("key").alias("start_key"), F.col("part").alias("start_part"), "before")
    ranked = mine.join(start, F.col("key").eqNullSafe(F.col("start_key")) & (F.col("part") == F.col("start_part")))
    pos = F.row_number().over(Window.partitionBy("key", "part").orderBy("h", "id")) + F.col("before")
    ends = spans.select(F.col("key").alias("span_key"), "target_id", "from", "to")
    at = ranked.withColumn("pos", pos).select("id", "key", "pos")
    return at.join(F.broadcast(ends), F.col("key").eqNullSafe(F.col("span_key")) & (F.col("pos") > F.col("from")) & (F.col("pos") <= F.col("to"))).select("target_id", "id")
