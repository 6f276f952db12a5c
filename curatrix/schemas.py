"""Fixed schemas and checks on columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _B, _L, _D = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()

#: The normalised record; 30 fields.
NORMALIZED = T.StructType(
    [T.StructField(n, _S) for n in ("id", "dataset", "split", "text", "loss_mode")]
    + [T.StructField(n, _B) for n in ("quality_valid_harmony", "quality_completion_nonempty", "quality_has_tool", "quality_valid_tool_schema")]
    + [T.StructField("stats_char_len", _L), T.StructField("meta_domain", _S), T.StructField("meta_difficulty_bin", _S), T.StructField("source_uuid", _S), T.StructField("source_license", _S)]
    + [T.StructField("source_used_in", T.ArrayType(_S)), T.StructField("source_data_source", _S), T.StructField("source_changed_answer_to_majority", _B)]
    + [T.StructField(n, _S) for n in ("source_capability_target", "source_reasoning", "source_tools_id")]
    + [T.StructField("source_tools_count", _L), T.StructField("meta_correctness", _D), T.StructField("meta_eval_best_setting", _S), T.StructField("meta_pass_k", _L), T.StructField("meta_correct_count", _L)]
    + [T.StructField(f"meta_correctness_{n}", _D) for n in ("low", "medium", "high", "high_with_tool", "high_no_tool")]
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, if it has all the columns; else an error before any job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_optional_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in order, cast to its types; those ``df`` lacks are typed nulls."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
