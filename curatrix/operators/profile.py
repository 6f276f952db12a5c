"""Profiles of raw and derived data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import unknown


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n): how often each label occurs, blank and null ones as unknown; with ``top`` the most frequent."""
    out = df.groupBy(unknown(F.col(column).cast("string")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def places(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(__k0, __k1, ... for the keys, __value, __n, __before, __all): how often each value occurs, how many of its group's are smaller, and how many there are.

    Values are counted, and the counts are summed up along range partitions, so no task holds a group. Nulls don't count;
    null keys are keys like any others.
    """
    from curatrix.operators.curation import running_offsets

    own = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("__k0")]
    key = [f"__k{i}" for i in range(len(own))]
    per = df.where(F.col(column).isNotNull()).select(*own, F.col(column).alias("__value")).groupBy(*key, "__value").agg(F.count(F.lit(1)).alias("__n"))
    at = running_offsets(per, "__n", *key, "__value")
    groups = at.groupBy(*key).agg(F.min("offset").alias("__from"), F.sum("__n").alias("__all")).select(*[F.col(k).alias(f"{k}_") for k in key], "__from", "__all")
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return at.join(groups, on).select(*key, "__value", "__n", (F.col("offset") - F.col("__from")).alias("__before"), "__all")


def quantiles(df: DataFrame, column: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """(*keys, one column for each of ``shares``): exact quantiles, interpolated between neighbours; a group without values has none."""
    at = places(df, column, *keys)
    key = [f"__k{i}" for i in range(len(keys))]
    holds = lambda place: (F.col("__before") <= place) & (place < F.col("__before") + F.col("__n"))
    ends = []
    for name, q in shares.items():
        place = F.lit(float(q)) * (F.col("__all") - 1)
        for side, k in (("low", F.floor(place)), ("high", F.ceil(place))):
            ends.append(F.max(F.when(holds(k), F.col("__value").cast("double"))).alias(f"__{side}_{name}"))
    got = at.groupBy(*key).agg(*ends, F.max("__all").alias("__n"))
    part = lambda q: F.lit(float(q)) * (F.col("__n") - 1) - F.floor(F.lit(float(q)) * (F.col("__n") - 1))
    between = [(F.col(f"__low_{n}") + part(q) * (F.col(f"__high_{n}") - F.col(f"__low_{n}"))).alias(n) for n, q in shares.items()]
    return got.where("__n is not null").select(*[F.col(k).alias(name) for k, name in zip(key, keys)], *between)


def column_quantiles(df: DataFrame, columns: tuple[str, ...], shares: dict[str, float], *keys: str) -> DataFrame:
    """(*keys, column, one column for each of ``shares``): exact quantiles of several columns in one go."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    return quantiles(df.select(*keys, each).select(*keys, "x.column", "x.v"), "v", shares, *keys, "column")


def nearest_rank(df: DataFrame, column: str, quantiles: tuple[float, ...], *keys: str) -> DataFrame:
    """(*keys, q, value): the value at place round(q (n - 1)) of the sorted values, halves to even; nulls don't count.

    Values are counted first, so only distinct values are sorted; see :func:`places`.
    """
    q = places(df, column, *keys).withColumn("__q", F.explode(F.array(*[F.lit(float(x)) for x in quantiles])))
    place = F.bround(F.col("__q") * (F.col("__all") - 1), 0)
    here = q.where((place >= F.col("__before")) & (place < F.col("__before") + F.col("__n")))
    return here.select(*[F.col(f"__k{i}").alias(name) for i, name in enumerate(keys)], F.col("__q").alias("q"), F.col("__value").alias("value"))


def numeric_summary(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(*keys, n, least, mean, median, p95, most): the median between neighbours, p95 at the nearest rank; null where no value is."""
    key = [f"__s{i}" for i in range(max(1, len(keys)))]
    rows = df.select(*([F.col(k).alias(n) for k, n in zip(keys, key)] or [F.lit(0).alias("__s0")]), F.col(column).alias("__v"))
    out = rows.groupBy(*key).agg(F.count("__v").alias("n"), F.min("__v").alias("least"), F.avg("__v").alias("mean"), F.max("__v").alias("most"))
    for more in (quantiles(rows, "__v", {"median": 0.5}, *key), nearest_rank(rows, "__v", (0.95,), *key).select(*key, F.col("value").alias("p95"))):
        names = [c for c in more.columns if c not in key]
        other = more.select(*[F.col(k).alias(f"{k}_") for k in key], *names)
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
        out = out.join(other, same, "left").drop(*[f"{k}_" for k in key])
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, key)], "n", "least", "mean", "median", "p95", "most")


def json_fields(df: DataFrame, text: str) -> DataFrame:
    """(field, type, n): how often each field of JSON objects has a value of each type; what is no object has no fields."""
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    rows = df.select(F.try_parse_json(F.col(text)).alias("v")).where(kind(F.col("v")) == "OBJECT")
    each = rows.select(F.explode(F.col("v").cast("map<string, variant>")).alias("field", "value"))
    return each.groupBy("field", kind(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def message_fields(df: DataFrame, text: str) -> DataFrame:
    """(role, field, type, n) of the messages in JSON lists of messages; other texts have none."""
    listed = F.expr(f"try_variant_get(try_parse_json({text}), '$', 'array<map<string, variant>>')")
    each = df.select(F.explode(listed).alias("m")).select(F.expr("try_variant_get(m['role'], '$', 'string')").alias("role"), F.explode("m").alias("field", "value"))
    return each.groupBy("role", "field", F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def field_profile(df: DataFrame, *fields: str) -> DataFrame:
    """(field, present, missing, least_length, mean_length, most_length) of text fields."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")).select("x.*")
    n = F.length("v")
    return rows.groupBy("field").agg(F.count("v").alias("present"), F.count_if(F.col("v").isNull()).alias("missing"), F.min(n).alias("least_length"), F.avg(n).alias("mean_length"), F.max(n).alias("most_length"))


def message_profile(df: DataFrame, text: str) -> DataFrame:
    """(role, channel, n, chars) of the messages of tagged texts."""
    from curatrix.operators.grammar import messages

    m = df.select(F.explode(messages(text)).alias("m")).select("m.*")
    return m.groupBy("role", F.coalesce("channel", F.lit("")).alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


def row_estimate(df: DataFrame, text: str) -> DataFrame:
    """(rows, bytes, mean_bytes) of lines, each with its line end."""
    b = F.octet_length(text) + 1
    return df.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("rows"), F.sum(b).alias("bytes"), F.avg(b).alias("mean_bytes"))


def distinct_counts(df: DataFrame, *columns: str, cap: int | None = None, approximate: bool = False) -> DataFrame:
    """(column, n): distinct values of each column, exact or estimated, at most ``cap``."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    # long texts meet as hashes of 128 bits
    short = F.when(F.octet_length("v") > 64, F.substring(F.sha2("v", 256), 1, 32)).otherwise(F.col("v"))
    n = F.approx_count_distinct("v") if approximate else F.count_distinct(short)
    return rows.groupBy("column").agg((F.least(n, F.lit(cap)) if cap else n).alias("n"))


def sequence_hash(df: DataFrame, text: str, *order: str) -> str:
    """SHA-256 of the texts in order, each followed by a zero byte; for small inputs, on the driver, row by row."""
    import hashlib

    h = hashlib.sha256()
    for r in df.orderBy(*order).select(F.coalesce(text, F.lit("")).alias("t")).toLocalIterator():
        h.update(r.t.encode() + b"\0")
    return h.hexdigest()
