"""Scalar functions on strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def rstrip(x: str | Column) -> Column:
    return F.regexp_replace(_c(x), r"(?U)\s+$", "")


def word_count(x: str | Column) -> Column:
    """Number of runs of non-space characters."""
    return F.size(F.filter(F.split(_c(x), r"(?U)\s+"), lambda w: w != ""))


def unknown(x: str | Column) -> Column:
    """A label; blank and null ones are ``unknown``."""
    return F.coalesce(F.nullif(strip(x), F.lit("")), F.lit("unknown"))


def difficulty(x: str | Column) -> Column:
    """low, medium, high, or unknown."""
    v = F.lower(strip(x))
    return F.when(v.isin("low", "medium", "high"), v).otherwise("unknown")


def split_difficulty(split: str | Column) -> Column:
    """The difficulty that a split's name begins with, or null."""
    s = F.lower(_c(split))
    return F.when(s.startswith("low"), "low").when(s.startswith("medium"), "medium").when(s.startswith("high"), "high")


def dataset_domain(dataset: str | Column) -> Column:
    """The domain that a dataset's name tells, tested in this order; math if none."""
    d = F.lower(_c(dataset))
    out = F.when(d.contains("proof"), "proof")
    for part, name in (("agentic", "agentic"), ("science", "science"), ("instruction", "chat_if")):
        out = out.when(d.contains(part), name)
    return out.otherwise("math")


def hash_head(x: str | Column) -> Column:
    """The first 32 bits of the SHA-1 of a stripped, lower-case id; 0 for an empty id."""
    v = F.lower(strip(x))
    return F.when(v == "", F.lit(0)).otherwise(F.conv(F.substring(F.sha1(v), 1, 8), 16, 10).cast("long"))


def hash31(x: str | Column) -> Column:
    """31 bits of the SHA-1 of a string."""
    return F.conv(F.substring(F.sha1(_c(x)), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << 31) - 1))


def length_label(x: str | Column, edges: tuple[int, ...], prefix: str = "len_", width: int = 5) -> Column:
    """The bucket of a length, such as ``len_00128_00256``; the last edge is open (``inf``), null counts as the first bucket."""
    v, name = F.coalesce(_c(x), F.lit(0)), lambda k: str(k).zfill(width)
    out = None
    for lo, hi in zip(edges, edges[1:]):
        label = F.lit(f"{prefix}{name(lo)}_{name(hi)}")
        out = F.when(v < hi, label) if out is None else out.when(v < hi, label)
    last = F.lit(f"{prefix}{name(edges[-1])}_inf")
    return last if out is None else out.otherwise(last)


def safe_name(x: str | Column) -> Column:
    """Letters, digits, _ and - as they are, all else _."""
    return F.regexp_replace(_c(x), r"[^A-Za-z0-9_-]", "_")


def answer_type(x: str | Column) -> Column:
    """empty, boxed, code, numeric, json or text, tested in this order."""
    v = strip(F.coalesce(_c(x), F.lit("")))
    return (
        F.when(v == "", "empty")
        .when(v.contains("\\boxed"), "boxed")
        .when(v.contains("```"), "code")
        .when(v.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), "numeric")
        .when(v.startswith("{") | v.startswith("["), "json")
        .otherwise("text")
    )


def human_bytes(n: str | Column) -> Column:
    """A size in B to PB with two decimals; n/a for null and 0."""
    x = _c(n).cast("double")
    out = F.when(F.coalesce(x, F.lit(0.0)) == 0, "n/a")
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    for i, u in enumerate(units):
        last = i == len(units) - 1
        shown = F.concat(F.format_string("%.2f", F.bround(x / float(1024**i), 2)), F.lit(" " + u))
        out = out.otherwise(shown) if last else out.when(x < float(1024 ** (i + 1)), shown)
    return out


def trace_field(x: str | Column, key: str) -> Column:
    """The value of a ``KEY: value`` line of a trace sketch, or null."""
    got = F.regexp_extract(_c(x), rf"(?m)^[ \t]*{key}:[ \t]*(.*)$", 1)
    return F.nullif(strip(got), F.lit(""))


def erf(x: Column) -> Column:
    """The error function, by the polynomial 7.1.26 of Abramowitz and Stegun (fixed values)."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))
