"""Tool traces: JSON payloads of calls and returns, and the behaviour signature of a conversation.

JSON as chat models write it needs a lenient parser (repeated keys, NaN) and recursion, so these are Arrow-batched
functions over plain Python ones.
"""

from __future__ import annotations

import json
import re
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Names under which payloads hold tools, arguments and nested calls, and of what kind those are.
NAME_KEYS = ("tool_name", "name", "tool", "function_name")
ARGUMENTS, FUNCTION = "arguments", "function"
CONTAINERS = {"tool_calls": list, "calls": list, "call": dict, "function_call": dict}
NESTED = (*CONTAINERS, "tool_call")
STANDARD = ("system", "developer", "user", "assistant")
START, CALL = "<|start|>", "<|call|>"
# What an answer says of a tool's output, and keys of errors.
USED_OUTPUT = re.compile(r"\b(tool output|based on the tool|according to the tool)\b", re.I)
ERRORS = ("error", "exception", "traceback")
_MESSAGE = re.compile(r"<\|start\|>(.*?)<\|message\|>(.*?)(<\|end\|>|<\|call\|>|<\|return\|>)", re.S)
_ROLE = re.compile(r"^assistant\s+to=(\S+)")


class Message(NamedTuple):
    role: str
    channel: str | None
    content: str
    end: str

    @property
    def output(self) -> bool:
        """Whether a tool speaks: a role that is none of the standard ones."""
        role = self.role.strip()
        return role != "" and role not in STANDARD and not role.startswith("assistant")

    @property
    def said(self) -> bool:
        """Whether the assistant says it to the user."""
        return (self.role == "assistant" or self.role.startswith("assistant ")) and self.channel in (None, "final")

    @property
    def addressed(self) -> str:
        """The tool that the role is addressed to, or ''."""
        to = _ROLE.match(self.role.strip())
        return to[1] if to else ""


def load(text: str | None, most: int = 50_000) -> Any:
    """The JSON object or list of a text, or None; longer texts than ``most`` aren't tried."""
    t = (text or "").strip()
    if not t or t[0] not in "{[" or len(t) > most:
        return None
    try:
        return json.loads(t)
    except ValueError:
        return None


def payload_ok(text: str | None) -> bool:
    """Whether a payload that looks like JSON is; blank and plain ones are fine."""
    t = (text or "").strip()
    return not t or t[0] not in "{[" or load(t, 1 << 60) is not None


def canonical(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def text_of(value: Any) -> str:
    return value.strip() if isinstance(value, str) else ""


def name_of(call: dict) -> str:
    """The name a payload gives its tool, or ''."""
    inner = call.get(FUNCTION)
    found = [*map(call.get, NAME_KEYS), inner.get("name") if isinstance(inner, dict) else None]
    return next(filter(None, map(text_of, found)), "")


def nested(value: dict) -> list:
    """What lies in the containers of a payload."""
    return [value[k] for k in NESTED if isinstance(value.get(k), (list, dict))]


def names_in(value: Any) -> list[str]:
    """All names in a value: the payload's own, that of its function, those of nested calls."""
    if isinstance(value, list):
        return [n for v in value for n in names_in(v)]
    if not isinstance(value, dict):
        return []
    own = next(filter(None, (text_of(value.get(k)) for k in NAME_KEYS)), "")
    inner = value.get(FUNCTION)
    return [n for n in (own, text_of(inner.get("name")) if isinstance(inner, dict) else "") if n] + names_in(nested(value))


def calls_in(value: Any) -> list[dict]:
    """The call payloads in a value: those in its containers, one level down, then the object itself if it looks like one."""
    if isinstance(value, list):
        return [c for v in value for c in calls_in(v)]
    if not isinstance(value, dict):
        return []
    held = [value[k] for k, kind in CONTAINERS.items() if isinstance(value.get(k), kind)]
    out = [c for h in held for c in (h if isinstance(h, list) else [h]) if isinstance(c, dict)]
    return out + [value] if value.keys() & {*NAME_KEYS, FUNCTION, ARGUMENTS} else out


def argument_keys(call: Any) -> list[str]:
    """Names of a call's arguments, sorted; those of the object itself if it holds neither arguments nor calls."""
    if isinstance(call, list):
        return sorted({k for v in call for k in argument_keys(v)})
    if not isinstance(call, dict):
        return []
    inner = call.get(FUNCTION)
    keys: set[str] = set()
    for args in (call.get(ARGUMENTS), inner.get(ARGUMENTS) if isinstance(inner, dict) else None):
        args = load(args, 10_000) if isinstance(args, str) else args
        keys |= set(args) if isinstance(args, dict) else set()
    keys |= {k for v in nested(call) for k in argument_keys(v)}
    if not keys and not call.keys() & {*NESTED, FUNCTION}:
        keys = set(call)
    return sorted({k.strip() for k in keys if k.strip()})


def return_status(text: str | None) -> str:
    """empty, error or ok."""
    t = (text or "").strip()
    if not t:
        return "empty"
    if any(e in t.lower() for e in ERRORS):
        return "error"
    v = load(t)
    if v in ({}, []):
        return "empty"
    return "error" if isinstance(v, dict) and "stderr" in v else "ok"


def keyset(text: str | None, most: int = 16) -> str:
    """The first sorted keys of a JSON object; dict_empty, list or nonjson."""
    v = load(text)
    if isinstance(v, dict):
        return ",".join(sorted(k for k in v if k.strip())[:most]) or "dict_empty"
    return "list" if isinstance(v, list) else "nonjson"


def trace(text: str | None) -> list[Message]:
    """The messages of a text; none of one that breaks the grammar."""
    t = text or ""
    found = [Message(*(h.split("<|channel|>", 1) if "<|channel|>" in h else (h, None)), c, d) for h, c, d in _MESSAGE.findall(t)]
    return [] if START in _MESSAGE.sub("\x01", t) else found


def call_sequence(messages: list[Message]) -> list[str]:
    """The tools called, in order, by the names that the payloads give."""
    out: list[str] = []
    for value in (load(m.content, 20_000) for m in messages if m.end == CALL):
        found = calls_in(value)
        out += [n for n in map(name_of, found) if n] if found else names_in(value)
    return out


def output_roles(messages: list[Message]) -> list[str]:
    """The tools that speak, in order: by role, or for the role ``tool`` by the name in what it says."""
    named = lambda m: names_in(load(m.content, 20_000)) if m.role.strip() == "tool" else []
    return [(named(m) or [m.role.strip()])[0] for m in messages if m.output]


def output_keysets(messages: list[Message]) -> list[str]:
    """The keys of what each tool says."""
    return [keyset(m.content) for m in messages if m.output]


def calls(messages: list[Message], most: int, keys: int = 16) -> list[tuple[str, list[str]]]:
    """(tool, argument keys) of the calls up to ``most`` payloads; a payload without a name goes by the role, one without either doesn't count."""
    out: list[tuple[str, list[str]]] = []
    for m in messages:
        if m.end != CALL:
            continue
        value = load(m.content, 20_000)
        payloads = calls_in(value)
        for p in payloads:
            if name := name_of(p) or m.addressed:
                out.append((name, argument_keys(p)[:keys]))
                if len(out) >= most:
                    return out
        if not payloads and (name := (names_in(value) or [m.addressed])[0]):
            out.append((name, argument_keys(value)[:keys]))
    return out


def returns(messages: list[Message], names: list[str]) -> list[tuple[str, str, str]]:
    """(status, keys, role) of the outputs that follow a call, the first after each; a nameless tool goes by the next call's name."""
    out: list[tuple[str, str, str]] = []
    called, due = 0, False
    for m in messages:
        if m.end == CALL and called < len(names):
            called, due = called + 1, True
        elif due and m.output and len(out) < len(names):
            role = m.role.strip()
            out.append((return_status(m.content), keyset(m.content), names[len(out)] if role == "tool" else role))
            due = False
    return out


def behaviour(text: str | None, most: int = 16) -> str:
    """The behaviour signature: calls with their argument keys, what they return, the kind of answer and the plan's beginning.

    Without calls, the outputs of tools stand for them. A call without an output returns ``missing``. A text that breaks
    the grammar, or null, has the signature of one without messages, which is empty.
    """
    rows = trace(text)
    if not rows and START in (text or ""):
        return ""
    made = calls(rows, most)
    if made:
        got = returns(rows, [n for n, _ in made])
    else:
        spoke = [m for m in rows if m.output][:most]
        made = [(f"tool[{keyset(m.content)}]" if m.role.strip() == "tool" else m.role.strip(), []) for m in spoke]
        got = [(return_status(m.content), keyset(m.content), n) for m, (n, _) in zip(spoke, made)]
    got += [("missing",) * 3] * (len(made) - len(got))
    final = next((m.content for m in reversed(rows) if m.said), "")
    own = [m for m in rows if m.role == "assistant" and m.content.strip()]
    plan = next((m.content for m in own if m.channel == "analysis"), own[0].content if own else "")
    status, keys, roles = zip(*got) if got else ((), (), ())
    lines = {
        "TOOL_SEQ": " -> ".join(n for n, _ in made) or "none",
        "CALLS": str(len(made)),
        "ARGS": " | ".join(f"{n}[{','.join(k)}]" for n, k in made) or "none",
        "RETURNS": " | ".join(status) or "none",
        "RET_KEYS": " | ".join(keys) or "none",
        "RET_ROLES": " | ".join(roles) or "none",
        "USED_TOOL_OUTPUT": "yes" if USED_OUTPUT.search(final) else "no",
        "ANSWER_TYPE": answer_kind(final),
        "PLAN_EXCERPT": " ".join(plan.split()[:128])[:800].rstrip(),
    }
    return "\n".join(f"{k}: {v}" for k, v in lines.items() if v)


def answer_kind(text: str) -> str:
    """empty, boxed, code, numeric, json or text."""
    t = text.strip()
    if not t:
        return "empty"
    if "\\boxed" in t:
        return "boxed"
    if "```" in t:
        return "code"
    if re.fullmatch(r"[-+]?\d+(\.\d+)?", t):
        return "numeric"
    return "json" if load(t, 1 << 60) is not None else "text"


def per_text(f) -> Any:
    """A function on the messages of a text, as one on strings: what it gives, joined by blanks and bars."""
    return F.pandas_udf(lambda x: x.map(lambda t: None if t is None else " | ".join(f(trace(t)))), StringType())


call_sequence_udf, output_roles_udf, output_keysets_udf = map(per_text, (call_sequence, output_roles, output_keysets))


@F.pandas_udf(BooleanType())
def payload_ok_udf(x: pd.Series) -> pd.Series:
    return x.map(payload_ok)


@F.pandas_udf(StringType())
def keyset_udf(x: pd.Series) -> pd.Series:
    return x.map(keyset)


@F.pandas_udf(StringType())
def behaviour_udf(x: pd.Series) -> pd.Series:
    return x.map(behaviour)


@F.pandas_udf(BooleanType())
def tool_payloads_ok_udf(x: pd.Series) -> pd.Series:
    """Whether all messages of tools in a text hold fine payloads."""
    return x.map(lambda t: all(payload_ok(m.content) for m in trace(t) if m.output))


def register(spark) -> None:
    """Make the functions available to SQL."""
    for name, f in (("payload_ok", payload_ok_udf), ("json_keyset", keyset_udf), ("behaviour_signature", behaviour_udf), ("tool_payloads_ok", tool_payloads_ok_udf), ("tool_calls", call_sequence_udf), ("tool_outputs", output_roles_udf), ("tool_output_keysets", output_keysets_udf)):
        spark.udf.register(name, f)
