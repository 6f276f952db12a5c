"""Sinks: sharded Parquet, pools, buckets, JSON lines, id lists, CSV, manifests and small reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import strip


def shards(df: DataFrame, path: str, rows: int = 100_000, by: tuple[str, ...] = (), compression: str = "zstd") -> None:
    """Parquet files of at most ``rows`` rows, in folders by the columns ``by``.

    Rows of one folder are spread over tasks by hash, so that a hot folder isn't one task's.
    """
    w = df.write.mode("errorifexists").option("maxRecordsPerFile", rows).option("compression", compression)
    (w.partitionBy(*by) if by else w).parquet(path)


def json_texts(df: DataFrame, path: str, text: str = "text") -> None:
    """One {"text": …} a line; blank texts are left out."""
    df.where(F.col(text).isNotNull() & (strip(text) != "")).select(F.col(text).alias("text")).write.json(path)


def id_list(df: DataFrame, path: str, *order: str, id_col: str = "id") -> None:
    """One id a line, in order; the files' names sort as the ids do."""
    df.orderBy(*order).select(F.col(id_col).cast("string")).write.text(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def manifest(path: str, **facts) -> None:
    """The facts of a run as sorted JSON."""
    Path(path).write_text(json.dumps(facts, sort_keys=True, indent=2, default=str) + "\n")


def tools_catalogue(df: DataFrame, tools: str) -> DataFrame:
    """(tools_id, tools): distinct tool lists by the SHA-1 of their canonical JSON."""
    from curatrix.operators.normalize import canonical_json_udf

    c = df.where(F.col(tools).isNotNull()).select(canonical_json_udf(tools).alias("tools")).where("tools is not null").distinct()
    return c.select(F.sha1("tools").alias("tools_id"), "tools")


def markdown(df: DataFrame, title: str, rows: int = 50) -> str:
    """A small report: the first rows as a table."""
    got = df.limit(rows).collect()
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(str(v) for v in r)} |\n" for r in got)


def dictionary_codes(df: DataFrame, column: str, most: int = 65_536) -> tuple[DataFrame, list[str]]:
    """``df`` with ``code``, and the labels by code, for viewers; an error for more than ``most`` labels."""
    from curatrix.functions.text import unknown

    labels = sorted(r[0] for r in df.select(unknown(column)).distinct().limit(most + 1).collect())
    if len(labels) > most:
        raise ValueError(f"more than {most} labels")
    codes = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(labels)], "__v string, code int")
    return df.withColumn("__v", unknown(column)).join(F.broadcast(codes), "__v").drop("__v"), labels
