"""Raw chat, proof and evaluation records brought to the normalised schema."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from curatrix.functions.text import dataset_domain, split_difficulty
from curatrix.operators.grammar import quality_flags, with_messages
from curatrix.operators.tools import canonical, tool_payloads_ok_udf
from curatrix.schemas import NORMALIZED, with_optional_columns

# Names under which models call the Python tool; prompts of the kinds of records.
PYTHON_NAMES = ("stateful_python_code_exec", "python_code_exec", "python")
PREAMBLE = "You are ChatGPT, a large language model trained by OpenAI.\nKnowledge cutoff: 2024-06\n\n"
MATH_SYSTEM = PREAMBLE + "Reasoning: {difficulty}\n\n# Valid channels: analysis, commentary, final. Channel must be included for every message."
MATH_DEVELOPER = "# Instructions\n\nYou will solve the problem and return the final answer in \\boxed{}. Do not guess the answer, unless specifically given permission to."
PROOF_SYSTEM = PREAMBLE + "# Task: Convert the user's math statement into Lean 4."
PROOF_DEVELOPER = "# Instructions\n\nConvert the math problem into a Lean 4 theorem statement. Return Lean code only."


def _shown(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _arguments(raw: Any) -> str:
    """What a call hands over: the code in its JSON, else the JSON with sorted keys, else the string; '' for anything but a string."""
    if not isinstance(raw, str) or not raw.strip():
        return ""
    try:
        value = json.loads(raw)
    except ValueError:
        return raw
    return value["code"] if isinstance(value, dict) and isinstance(value.get("code"), str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _call(call: Any) -> tuple[str, str, str, str] | None:
    """The message of one tool call; None for one that isn't an object or hands nothing over."""
    f = (call.get("function") or {}) if isinstance(call, dict) else None
    text = _arguments(f.get("arguments")) if isinstance(f, dict) else ""
    if not text:
        return None
    name = "python" if f.get("name") in PYTHON_NAMES else f.get("name")
    return f"assistant to={name}" if name else "assistant", "analysis", text, "<|call|>"


def conversation(messages: list[dict], system: str | None = None, developer: str | None = None) -> str:
    """The tagged text of chat messages, after a prompt of the system and of the developer if given.

    An assistant message becomes its reasoning, then its tool calls or, if it has none, its content; blank ones and
    calls that hand nothing over are left out. A tool goes by its name. Messages without a role are left out.
    """
    out: list[tuple[str, str | None, str, str]] = [(r, None, p, "<|end|>") for r, p in (("system", system), ("developer", developer)) if p is not None]
    for m in messages:
        role, content = m.get("role"), m.get("content")
        if not isinstance(role, str) or not role:
            continue
        if role == "assistant":
            thought, made = m.get("reasoning_content"), m.get("tool_calls")
            if isinstance(thought, str) and thought.strip():
                out.append((role, "analysis", thought, "<|end|>"))
            if isinstance(made, list) and made:
                out += [c for c in map(_call, made) if c]
            elif isinstance(content, str) and content.strip():
                out.append((role, "final", content, "<|end|>"))
        elif role == "tool":
            name = m.get("name")
            out.append((name.strip() if isinstance(name, str) and name.strip() else role, "commentary", _shown(content), "<|end|>"))
        else:
            out.append((role, None, _shown(content), "<|end|>"))
    if out and out[-1][3] == "<|end|>":
        out[-1] = (*out[-1][:3], "<|return|>")
    return "".join(f"<|start|>{r}{'<|channel|>' + c if c else ''}<|message|>{t}{e}" for r, c, t, e in out)


@F.pandas_udf(StringType())
def conversation_udf(x: pd.Series) -> pd.Series:
    """The tagged text of JSON message lists; null for what isn't one."""

    def one(t: str | None) -> str | None:
        try:
            v = json.loads(t)
            return conversation(v) if isinstance(v, list) else None
        except (TypeError, ValueError, AttributeError):
            return None

    return x.map(one)


@F.pandas_udf(StringType())
def canonical_json_udf(x: pd.Series) -> pd.Series:
    """JSON with sorted keys and no white space; null for what isn't JSON."""

    def one(t: str | None) -> str | None:
        try:
            return canonical(json.loads(t))
        except (TypeError, ValueError):
            return None

    return x.map(one)


def proof_text(problem: Column, header: Column, statement: Column) -> Column:
    """A proof record as a question and its formal answer."""
    answer = F.concat(F.regexp_replace(F.coalesce(header, F.lit("")), r"(?U)\s+$", ""), F.lit("\n\n"), F.regexp_replace(statement, r"(?U)^\s+", ""))
    return F.concat(F.lit("<|start|>user<|message|>"), problem, F.lit("<|end|><|start|>assistant<|channel|>final<|message|>"), answer, F.lit("<|return|>"))


def best_setting(metadata: str) -> dict[str, Column]:
    """Correctness columns of array<struct<setting, accuracy>>: the best setting (the first of equals) and the best of each reasoning level."""
    m = F.col(metadata)
    rows = F.transform(m, lambda x, i: F.struct(x["accuracy"].alias("a"), (-i).alias("p"), x["setting"].alias("s")))
    best = F.array_max(F.filter(rows, lambda x: x["a"].isNotNull() & ~F.isnan(x["a"])))
    level = lambda p: F.array_max(F.transform(F.filter(m, lambda x: x["setting"].startswith(f"reason_{p}")), lambda x: x["accuracy"]))
    return {"meta_correctness": best["a"], "meta_eval_best_setting": best["s"]} | {f"meta_correctness_{p}": level(p) for p in ("low", "medium", "high", "high_with_tool", "high_no_tool")}


def normalize(df: DataFrame, dataset: str, split: str, text: str = "text", dedup: bool = True, drop_invalid: bool = False, drop_empty: bool = False) -> DataFrame:
    """Texts with their id, flags and labels, in the normalised schema; null texts don't come out.

    The id is the SHA-1 of the text. Of equal texts one remains (the smallest dataset and split), before invalid and
    empty ones are dropped.
    """
    rows = df.where(F.col(text).isNotNull()).withColumn("__text", F.col(text)).withColumn("id", F.sha1("__text")).withColumn("dataset", F.col(dataset)).withColumn("split", F.col(split))
    if dedup:
        from curatrix.operators.curation import keep_first

        rows = keep_first(rows, "id", "dataset", "split", F.xxhash64(*df.columns))
    q = quality_flags("__text", F.col("__messages"))
    out = (
        with_messages(rows, "__text").withColumn("text", F.col("__text"))
        .withColumn("loss_mode", F.lit("assistant_all"))
        .withColumn("quality_valid_harmony", q["valid"])
        .withColumn("quality_completion_nonempty", q["completion_nonempty"])
        .withColumn("quality_has_tool", q["has_tool"])
        .withColumn("quality_valid_tool_schema", q["valid"] & tool_payloads_ok_udf("__text"))
        .withColumn("stats_char_len", F.length("__text"))
        .withColumn("meta_domain", dataset_domain("dataset"))
        .withColumn("meta_difficulty_bin", split_difficulty("split"))
    )
    if drop_invalid:
        out = out.where("quality_valid_harmony")
    if drop_empty:
        out = out.where("quality_completion_nonempty")
    return with_optional_columns(out, NORMALIZED)
