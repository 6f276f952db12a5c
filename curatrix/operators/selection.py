"""Diverse selection: LSH buckets, quotas, dense head and tail, capped greedy picks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lsh_keys(df: DataFrame, vec_col: str, dim: int, bits: int = 22, seed: int = 0) -> DataFrame:
    """``df`` without its vector and with ``bucket_key``: bit j tells on which side of random plane j the vector lies.

    Vectors that are null or of another length have a null key.
    """
    if not 0 < bits <= 63:
        raise ValueError("bits must be from 1 to 63")
    planes = np.random.default_rng(seed).standard_normal((dim, bits)).astype(np.float32)
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64)).astype(np.int64)
    keep = [f for f in df.schema.fields if f.name != vec_col]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ok = np.array([v is not None and len(v) == dim for v in p[vec_col]], bool)
            key = np.zeros(len(p), np.int64)
            if ok.any():
                key[ok] = ((np.stack(p[vec_col][ok].to_list()).astype(np.float32) @ planes) > 0) @ weights
            out = p.drop(columns=[vec_col])
            out["bucket_key"] = pd.Series(key, index=p.index).where(ok).astype("Int64")
            yield out

    return df.mapInPandas(run, T.StructType([*keep, T.StructField("bucket_key", T.LongType())]))


def bucket_best(df: DataFrame, keys: tuple[str, ...], score: str, tie: str, *carry: str) -> DataFrame:
    """(*keys, bucket_count, score, tie, *carry) of the best row of each bucket; null and NaN scores count as -1, ties go to the smaller ``tie``."""
    s = F.when(F.col(score).isNull() | F.isnan(F.col(score).cast("double")), F.lit(-1.0)).otherwise(F.col(score).cast("double"))
    best = F.min(F.struct((-s).alias("neg"), F.col(tie).alias(tie), *carry))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket_count"), best.alias("b")).select(*keys, "bucket_count", (-F.col("b.neg")).alias("score"), f"b.{tie}", *[f"b.{c}" for c in carry])


def bucket_top_distinct(df: DataFrame, bucket: str, group: str, score: str, tie: str, keep: int = 3) -> DataFrame:
    """At most ``keep`` rows a bucket, the best of each group; ``bucket_count`` counts all rows of the bucket."""
    best = bucket_best(df, (bucket, group), score, tie)
    per = Window.partitionBy(bucket)
    ranked = best.withColumn("bucket_rows", F.sum("bucket_count").over(per)).withColumn("pick", F.row_number().over(per.orderBy(F.desc("score"), tie)))
    return ranked.where(F.col("pick") <= keep).select(bucket, group, tie, "score", "pick", F.col("bucket_rows").alias("bucket_count"))


def dense_and_tail(df: DataFrame, k: int, count: str, key: str, dense: float = 0.8, seed: int = 0) -> DataFrame:
    """``k`` rows: the share ``dense`` of them by the greatest ``count``, the others by the hash of ``key`` from the rest; ``part`` tells which."""
    head = df.orderBy(F.desc(count), key).limit(round(k * dense)).withColumn("part", F.lit("dense"))
    rest = df.join(head.select(key), key, "left_anti")
    tail = rest.orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k - round(k * dense)).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def largest_remainder(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers in proportion to ``shares`` that add up to ``total``; ties of the remainders go by name."""
    whole = sum(shares.values())
    if total <= 0 or whole <= 0:
        return dict.fromkeys(shares, 0)
    raw = {k: total * v / whole for k, v in shares.items()}
    out = {k: int(v + 1e-9) for k, v in raw.items()}
    for k in sorted(raw, key=lambda k: (-round(raw[k] - out[k], 9), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def borrow(quota: dict[str, int], supply: dict[str, int], order: tuple[str, ...] = ("math", "agentic", "chat_if", "science", "proof")) -> dict[str, int]:
    """Quotas within the supply; what one lacks is taken from the others in ``order`` (then by name)."""
    out = {k: min(v, supply.get(k, 0)) for k, v in quota.items()}
    lack = sum(quota.values()) - sum(out.values())
    for k in [*(o for o in order if o in out), *sorted(set(out) - set(order))]:
        more = min(lack, supply.get(k, 0) - out[k])
        out[k], lack = out[k] + more, lack - more
    return out


def donate(quota: dict[str, int], supply: dict[str, int]) -> dict[str, int]:
    """Quotas within the supply; what some lack goes to those with the most to spare, then by name. An error if all have too little."""
    out = {k: min(v, supply.get(k, 0)) for k, v in quota.items()}
    lack = sum(quota.values()) - sum(out.values())
    spare = {k: supply.get(k, 0) - v for k, v in out.items()}
    for k in sorted(spare, key=lambda k: (-spare[k], k)):
        more = min(spare[k], lack)
        out[k], lack = out[k] + more, lack - more
    if lack:
        raise ValueError(f"{lack} more wanted than there are")
    return out


def quota_top(df: DataFrame, group: str, quota: dict[str, int], score: str, tie: str) -> DataFrame:
    """The best rows of each group up to its quota, with their ``rank``."""
    limits = F.create_map(*[x for k, v in quota.items() for x in (F.lit(k), F.lit(v))]) if quota else None
    if limits is None:
        return df.withColumn("rank", F.lit(0)).limit(0)
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    most = max(quota.values(), default=0)
    ranked = df.where(F.col(group).isin(*quota)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.where(F.col("rank") <= F.element_at(limits, F.col(group)))


def capped_pick(df: DataFrame, k: int, group: str, bucket: str, count: str, score: str, tie: str, fraction: float = 0.35) -> DataFrame:
    """``k`` rows, one a bucket, walking the buckets from the fullest: the best row whose group is still under its cap.

    The cap is max(1, floor(fraction k)); a second walk over the buckets left fills up without it. ``tie`` tells the rows
    of a bucket apart; null groups are a group, null buckets don't come out.

    The walk goes on in rounds. At most k // cap groups can be full, so of a bucket only the best rows of so many groups
    and one more can be picked; of the buckets, a round takes as many as rows are still wanted, those first in order in
    which a group is left. A round ends with all picked or another group full, so there are k // cap + 1 at most.
    """
    from curatrix.session import cut_lineage

    cap = max(1, int(fraction * k))
    full = k // cap
    better = [F.desc(score), F.col(tie)]
    rows = df.where(F.col(bucket).isNotNull())
    one = rows.withColumn("__one", F.row_number().over(Window.partitionBy(bucket, group).orderBy(*better))).where("__one = 1").drop("__one")
    near = one.withColumn("__r", F.row_number().over(Window.partitionBy(bucket).orderBy(*better))).where(F.col("__r") <= full + 1)
    fill = rows.groupBy(F.col(bucket).alias("__k")).agg(F.max(count).alias("__c"))
    near = cut_lineage(near.join(fill, F.col(bucket) == F.col("__k")).drop("__k"))
    spark = df.sparkSession
    kind = near.select(F.col(bucket).alias("__b"), F.col(tie).alias("__t")).schema
    picked: list[tuple] = []
    used: dict = {}

    def left() -> DataFrame:
        if not picked:
            return near
        return near.join(spark.createDataFrame([(b,) for b, _ in picked], kind[:1]), F.col(bucket) == F.col("__b"), "left_anti")

    for capped in (True, False):
        while (want := k - len(picked)) > 0:
            rows = left()
            shut = {g for g, n in used.items() if n >= cap} if capped else set()
            if shut:
                rows = rows.where(~F.coalesce(F.col(group).isin([g for g in shut if g is not None]), F.lit(False)) & (F.lit(None not in shut) | F.col(group).isNotNull()))
            ahead = rows.groupBy(bucket).agg(F.max("__c").alias("__c")).orderBy(F.desc("__c"), bucket).limit(want).select(F.col(bucket).alias("__b"))
            # at most (k // cap + 1) k rows of four values
            walk = rows.join(ahead, F.col(bucket) == F.col("__b"), "left_semi").select(bucket, group, tie, "__c", "__r").orderBy(F.desc("__c"), bucket, "__r").collect()
            if not walk:
                break
            seen = set()
            for r in walk:
                if r[bucket] not in seen and len(picked) < k and (not capped or used.get(r[group], 0) < cap):
                    seen.add(r[bucket]), picked.append((r[bucket], r[tie]))
                    used[r[group]] = used.get(r[group], 0) + 1
    chosen = spark.createDataFrame(picked, kind)
    return near.join(chosen, (F.col(bucket) == F.col("__b")) & F.col(tie).eqNullSafe(F.col("__t")), "left_semi").select(*df.columns)


def best_of_each(df: DataFrame, keys: tuple[str, ...], score: str, id_col: str = "id", seed: int = 0) -> DataFrame:
    """One row for each combination of ``keys``: the best by score (null and NaN last), then by the CRC-32 of seed and id, then by id."""
    s = F.when(F.isnan(F.col(score).cast("double")), None).otherwise(F.col(score))
    tie = F.crc32(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))).bitwiseAND(0x7FFFFFFF)
    w = Window.partitionBy(*keys).orderBy(s.desc_nulls_last(), tie, id_col)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def composite_key(stratum: str, key: str, bits: int) -> Column:
    """The number of a stratum before a key of ``bits`` bits; an error when computed where the two don't fit in 63 bits."""
    s, k = F.col(stratum).cast("long"), F.col(key).cast("long")
    fits = (s >= 0) & (k >= 0) & (F.shiftrightunsigned(k, bits) == 0) & (F.shiftrightunsigned(s, 63 - bits) == 0)
    return F.when(s.isNull() | k.isNull(), None).when(fits, F.shiftleft(s, bits).bitwiseOR(k)).otherwise(F.raise_error(F.lit("composite key beyond 63 bits")).cast("long"))


def sequence_backfill(df: DataFrame, k: int, sequence: str, rank: str, most: int, distinct: int) -> DataFrame:
    """``k`` rows by rank, at most ``most`` of a sequence; first those that are the first of ``distinct`` different sequences.

    A sequence's first row is the same in both phases, so both are one order: the firsts of the sequences ahead, then
    the rest. ``rank`` must tell rows apart; ``phase`` tells which.
    """
    turn = F.row_number().over(Window.partitionBy(sequence).orderBy(rank))
    near = df.withColumn("__turn", turn).where(F.col("__turn") <= most)
    ahead = near.where("__turn = 1").orderBy(rank).limit(min(k, distinct)).select(rank)
    first = near.join(ahead, rank, "left_semi").withColumn("phase", F.lit(1))
    rest = near.join(ahead, rank, "left_anti").withColumn("phase", F.lit(2))
    return first.unionByName(rest).orderBy("phase", rank).limit(k).drop("__turn")


def sequence_cap(df: DataFrame, sequence: str, rank: str, most: int) -> DataFrame:
    """At most ``most`` rows of each sequence, by rank."""
    w = Window.partitionBy(sequence).orderBy(rank)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def length_strata(df: DataFrame, length: str, quantiles: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) -> tuple[DataFrame, list[float]]:
    """``df`` with ``stratum``, and the edges: quantiles of the length, strictly rising, the last one past the largest."""
    from curatrix.operators.profile import quantiles as exact

    found = exact(df, length, {f"q{i}": q for i, q in enumerate(quantiles)}).first()  # one row
    got = list(found) if found else []
    if not got:
        return df.withColumn("stratum", F.lit(0)), [0.0]
    edges = [0.0]
    for e in got[1:-1]:
        edges.append(max(e, edges[-1] + 1))
    edges.append(max(got[-1] + 1, edges[-1] + 1))
    at = F.lit(0)
    for e in edges[1:-1]:
        at = at + F.when(F.col(length) >= e, 1).otherwise(0)
    return df.withColumn("stratum", at), edges
