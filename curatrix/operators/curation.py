"""Filters, pools, keep-first, joins, length buckets, samples and blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import hash_head, length_label, strip
from curatrix.schemas import require_columns

QUALITY = ("quality_valid_harmony", "quality_completion_nonempty", "quality_valid_tool_schema")


def base_quality(df: DataFrame, flags: tuple[str, ...] = QUALITY) -> Column:
    """Whether all quality flags that ``df`` has are true; null is false, an absent flag doesn't count."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for c in flags if c in df.columns], F.lit(True))


def candidate_filter(df: DataFrame, require: tuple[str, ...] = (), domains: tuple[str, ...] = (), difficulties: tuple[str, ...] = (), correctness_ge: float | None = None) -> DataFrame:
    """Rows that pass the filters whose columns ``df`` has; a null never passes, nor does a NaN correctness."""
    out = df
    for c in require:
        if c in df.columns:
            out = out.where(F.coalesce(F.col(c), F.lit(False)))
    for c, values in (("meta_domain", domains), ("meta_difficulty_bin", difficulties)):
        if values and c in df.columns:
            out = out.where(F.col(c).isin(*values))
    if correctness_ge is not None and "meta_correctness" in df.columns:
        out = out.where((F.col("meta_correctness") >= correctness_ge) & ~F.isnan("meta_correctness"))
    return out


def hash_sample(df: DataFrame, modulus: int, keep: int, id_col: str = "id") -> DataFrame:
    """Rows whose id hashes below ``keep`` of ``modulus``; ids that differ in case or outer white space share their fate."""
    return df.where(F.pmod(hash_head(id_col), F.lit(modulus)) < keep)


def pools(df: DataFrame, high: float = 0.875, low: float = 0.25) -> DataFrame:
    """``df`` with a row for each ``pool`` a row belongs to; pools overlap and exist only if their columns do.

    A NaN correctness is given, but neither high, low nor between.
    """
    has = set(df.columns)
    tests: dict[str, Column] = {}
    if "quality_has_tool" in has:
        tests["tool_use"] = F.col("quality_has_tool")
    if "meta_correctness" in has:
        c = F.col("meta_correctness")
        real = c.isNotNull() & ~F.isnan(c)
        tests |= {
            "has_correctness_meta": c.isNotNull(),
            "missing_correctness_meta": c.isNull(),
            "high_correctness": real & (c >= high),
            "low_correctness": real & (c <= low),
            "mid_correctness": real & (c > low) & (c < high),
        }
    else:
        tests["missing_correctness_meta"] = F.lit(True)
    if {"meta_domain", "meta_difficulty_bin", "meta_correctness_high"} <= has:
        h = F.col("meta_correctness_high")
        tests["math_high_verified_correct"] = (F.col("meta_domain") == "math") & (F.col("meta_difficulty_bin") == "high") & (h >= high) & ~F.isnan(h)
    for column, values in (("source_reasoning", ("on", "off")), ("source_capability_target", ("chat", "structured_outputs"))):
        if column in has:
            for v in values:
                tests[f"{'reasoning' if column == 'source_reasoning' else 'capability'}_{v}"] = F.col(column) == v
    named = F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])
    return df.withColumn("pool", F.explode(F.filter(named, lambda x: x.isNotNull())))


def keep_first(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key by ``order``, which must tell rows apart; rows without a key don't come out.

    Spark limits each task's rows of a key to the first before the shuffle, so a hot key moves few.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def only_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with one of the ids."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def require_all_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with one of the ids, each id once by the caller's promise; an error if an id has no row or more than one."""
    out = only_ids(df, ids, id_col)
    wanted, found = ids.where(F.col(id_col).isNotNull()).select(id_col).distinct().count(), out.count()
    if wanted != found:
        raise ValueError(f"{wanted} ids, {found} rows")
    return out


def token_length(df: DataFrame, length: str = "stats_tok_len", tokens: str = "input_ids") -> Column:
    """The token count of a row: ``length`` where the table has it, else the length of the list of tokens; null where neither is."""
    have = [F.col(length)] if length in df.columns else []
    have += [F.when(F.col(tokens).isNotNull(), F.size(tokens))] if tokens in df.columns else []
    return F.coalesce(*have).cast("long") if have else F.lit(None).cast("long")


def missing_ids(ids: DataFrame, df: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct ids that ``df`` has no row of."""
    return ids.where(F.col(id_col).isNotNull()).select(id_col).distinct().join(df.select(id_col), id_col, "left_anti")


def attach_group(df: DataFrame, mapping: DataFrame, groups: tuple[str, ...] = (), id_col: str = "id", group: str = "mix_group", on_missing: str = "drop") -> DataFrame:
    """``df`` with the group of its id; ids match without case and outer white space, of several groups the last in name counts.

    Rows without a group are dropped, or with ``on_missing="fail"`` raise an error when the result is computed.
    """
    key = F.lower(strip(id_col))
    m = mapping.select(key.alias("__k"), F.lower(strip(group)).alias(group)).where((F.col("__k") != "") & (F.col(group) != "")).groupBy("__k").agg(F.max(group).alias(group))
    out = df.drop(group).withColumn("__k", key)
    if on_missing == "fail":
        out = out.join(m, "__k", "left").withColumn(group, F.coalesce(group, F.raise_error(F.lit("id without a group")).cast("string")))
    else:
        out = out.join(m, "__k")
    out = out.drop("__k")
    return out.where(F.col(group).isin(*groups)) if groups else out


def export_selected(selected: DataFrame, normalized: DataFrame, keys: tuple[str, ...] = ("dataset", "split", "id"), order: tuple[str, ...] = ("ingested_at",)) -> DataFrame:
    """The normalised rows of the selected keys, one per id."""
    require_columns(normalized, *keys)
    return keep_first(normalized.join(selected.select(*keys).distinct(), list(keys), "left_semi"), "id", *order, "text")


def length_buckets(df: DataFrame, length: str, edges: tuple[int, ...] = (0, 128, 256, 512)) -> DataFrame:
    return df.withColumn("len_bucket", length_label(length, edges))


def shard_of(df: DataFrame, index: int, count: int, key: str = "id") -> DataFrame:
    """The rows of shard ``index`` of ``count``."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(count)) == index)


def smallest_hashes(df: DataFrame, k: int, key: str, seed: int, per: str | None = None) -> DataFrame:
    """The ``k`` rows with the smallest SHA-256 of seed and key, of all or ``per`` group, with their ``score``."""
    scored = df.withColumn("score", F.substring(F.sha2(F.concat(F.lit(f"{seed}\n"), F.col(key).cast("string")), 256), 1, 16))
    if per is None:
        return scored.orderBy("score", key).limit(k)
    w = Window.partitionBy(per).orderBy("score", key)
    return scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def round_robin(df: DataFrame, pack: str, *order: str) -> DataFrame:
    """``df`` with ``turn`` and ``place``: packs take turns, each in its own order; sort by both for the union.

    A row's turn is its place in the whole order of packs less that of its pack's first row, so no pack is one task's.
    """
    at = running_offsets(df.withColumn("__one", F.lit(1)), "__one", pack, *order)
    firsts = at.groupBy(pack).agg(F.min("offset").alias("__from"))  # one row a pack
    packs = firsts.withColumn("place", F.row_number().over(Window.orderBy(pack)) - 1)
    return at.join(packs, pack).withColumn("turn", F.col("offset") - F.col("__from")).drop("__one", "offset", "__from")


def running_offsets(df: DataFrame, size: str, *order: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``offset``: the sum of ``size`` of all rows before it in the order.

    Rows are range-partitioned; each partition's total, one number, gives the next its start, so no task holds all rows.
    """
    from curatrix.session import cut_lineage

    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    totals = placed.groupBy("__p").agg(F.sum(size).alias("__t"))
    start = totals.select("__p", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    w = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("__b", F.coalesce(F.sum(size).over(w), F.lit(0))).join(F.broadcast(start), "__p").withColumn("offset", F.col("__b") + F.col("__s")).drop("__p", "__b", "__s")


def block_pieces(df: DataFrame, tokens: str, block: int, *order: str) -> DataFrame:
    """``df`` with a row for each ``block`` that its tokens and one end token reach into: (block, first, length).

    Rows follow each other without gaps; ``first`` is the place in the row's own tokens, ``length`` how many of them
    lie in the block. The last block may be short.
    """
    sized = running_offsets(df.withColumn("__n", F.col(tokens) + 1), "__n", *order)
    lo, hi = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("__n") - 1) / block)
    out = sized.withColumn("block", F.explode(F.sequence(lo, hi)))
    begin = F.greatest(F.col("offset"), F.col("block") * block)
    end = F.least(F.col("offset") + F.col("__n"), (F.col("block") + 1) * block)
    return out.withColumn("first", begin - F.col("offset")).withColumn("length", end - begin).drop("__n")


def strided(df: DataFrame, m: int, *order: str) -> DataFrame:
    """``m`` rows at even steps of the order (all, if there are fewer)."""
    n = df.count()
    if n <= m:
        return df
    at = running_offsets(df.withColumn("__one", F.lit(1)), "__one", *order)
    # row p is picked if p = floor(i n / m) for some i
    i = F.ceil(F.col("offset") * m / n)
    return at.where((i < m) & (F.floor(i * n / m) == F.col("offset"))).drop("__one", "offset")
