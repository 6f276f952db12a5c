"""Sources: Parquet trees, JSON lines with counted failures, id and mapping files, half-precision vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.text import strip


def parquet_tree(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """All Parquet files below a folder as one table."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return df.select(*columns) if columns else df


def texts(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    return parquet_tree(spark, path, column).where(F.col(column).isNotNull())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines with ``bad`` true for lines that hold no object; blank lines are skipped. Files may be compressed."""
    lines = spark.read.text(path).where(strip("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    bad = F.col("r").isNull() | F.col("r.__corrupt").isNotNull() | ~strip("value").startswith("{")
    return parsed.select("r.*", bad.alias("bad")).drop("__corrupt")


def split_of(name: Column) -> Column:
    """The split that a file name tells."""
    base = F.regexp_extract(name, r"([^/]+)$", 1)
    part = F.regexp_extract(base, r"^(\w+)\.part_(\d+)\.jsonl", 1)
    return (
        F.when(base.endswith(".parquet"), F.substring_index(F.regexp_replace(base, r"\.parquet$", ""), "-", 1))
        .when(part != "", F.concat(part, F.lit("_part"), F.regexp_extract(base, r"\.part_(\d+)\.jsonl", 1)))
        .otherwise(F.regexp_replace(base, r"\.jsonl(\.gz)?$", ""))
    )


def files_of_shard(paths: list[str], index: int, count: int) -> list[str]:
    """The files of shard ``index`` of ``count``: every ``count``-th of the sorted paths."""
    if not 0 <= index < count:
        raise ValueError("index must be below count")
    return sorted(paths)[index::count]


def one_kind(names: list[str]) -> list[str]:
    """``names``, if all are Parquet or all JSON lines (compressed or not); else an error."""
    kinds = {"parquet" if n.endswith(".parquet") else "jsonl" if n.endswith((".jsonl", ".jsonl.gz", ".jsonl.zst")) else n for n in names}
    if len(kinds) > 1:
        raise ValueError(f"files of different kinds: {', '.join(sorted(kinds))}")
    return names


def ids_file(spark: SparkSession, path: str) -> DataFrame:
    """(id): the lines that aren't blank, stripped."""
    return spark.read.text(path).select(strip("value").alias("id")).where("id <> ''")


def mapping_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, mix_group) of a Parquet file, or of lines with tab or comma; # begins a comment line, of repeated ids the last line counts (in Parquet the last group by name)."""
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path).select("id", "mix_group")
    else:
        at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))  # lines of a file in order
        lines = spark.read.text(path).select("value", at.alias("at")).where(~strip("value").startswith("#") & value_has("value"))
        rows = lines.select(F.split("value", r"[\t,]", 2).alias("p"), "at").select(strip(F.col("p")[0]).alias("id"), strip(F.col("p")[1]).alias("mix_group"), "at")
        return rows.groupBy("id").agg(F.max_by("mix_group", "at").alias("mix_group"))
    return rows.groupBy("id").agg(F.max("mix_group").alias("mix_group"))


def value_has(column: str) -> Column:
    return F.regexp_like(F.col(column), F.lit(r"[\t,]"))


def front_matter_splits(text: str) -> dict[str, str]:
    """{split: path} of the default configuration in a card's front matter: the indented ``split:`` and ``path:`` lines."""
    head = text.split("---")[1] if text.startswith("---") and text.count("---") > 1 else ""
    out, split, default = {}, None, True
    for line in head.splitlines():
        key, _, value = line.strip().lstrip("- ").partition(":")
        value = value.strip().strip("'\"")
        if key == "config_name":
            default = value == "default"
        elif key == "split":
            split = value
        elif key == "path" and split and default:
            out.setdefault(split, value)
    return out


def sample_per_file(df: DataFrame, k: int, key: str, seed: int = 0, most: int | None = None) -> DataFrame:
    """At most ``k`` rows of each file, by hash, and at most ``most`` of all."""
    from pyspark.sql import Window

    h = F.xxhash64(key, F.lit(seed))
    w = Window.partitionBy("__f").orderBy(h, key)
    out = df.withColumn("__f", F.col("_metadata.file_path")).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__f", "__r")
    return out.orderBy(h, key).limit(most) if most else out


def half_precision(spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, embedding) of Parquet files with 16-bit floats, which Spark's own reader doesn't take; one task a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            for raw in b.column("content"):
                for part in pq.ParquetFile(pa.BufferReader(raw.as_buffer())).iter_batches(8192, columns=[id_col, vec_col]):
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1).cast(pa.list_(pa.float32()))], names=["id", "embedding"])

    return files.mapInArrow(run, "id string, embedding array<float>")
