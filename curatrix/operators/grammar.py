"""The tagged conversation text: parsing, rendering, spans, quality flags and views, as column expressions.

A message is a start tag, a header, a message tag, a content and the nearest of three closing tags; the header is a
role with, after the first channel tag, a channel. What lies between messages is ignored. A text is valid unless a
start tag is left that no message begins with; a text without tags is valid and has no messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import rstrip, strip

# The tags of the format.
START, MESSAGE, CHANNEL = "<|start|>", "<|message|>", "<|channel|>"
END, CALL, RETURN = "<|end|>", "<|call|>", "<|return|>"
PATTERN = r"(?s)<\|start\|>(.*?)<\|message\|>(.*?)(<\|end\|>|<\|call\|>|<\|return\|>)"
STANDARD = ("system", "developer", "user", "assistant")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _part(x: Column, group: int) -> Column:
    return F.regexp_extract_all(x, F.lit(PATTERN), F.lit(group))


def messages(text: str | Column) -> Column:
    """array<struct<role, channel, content, end_tag>> of a text; null for null."""

    def one(w: Column) -> Column:
        # the text is matched once; the header ends at the first message tag, and no tag is within the closing one
        h = F.substring_index(w.substr(F.lit(len(START) + 1), F.length(w)), MESSAGE, 1)
        end = F.concat(F.lit("<|"), F.substring_index(w, "<|", -1))
        skip = F.length(h) + len(START) + len(MESSAGE)
        at = F.instr(h, CHANNEL)
        return F.struct(
            F.when(at > 0, F.substring_index(h, CHANNEL, 1)).otherwise(h).alias("role"),
            F.when(at > 0, h.substr(at + len(CHANNEL), F.length(h))).alias("channel"),
            w.substr(skip + 1, F.length(w) - skip - F.length(end)).alias("content"),
            end.alias("end_tag"),
        )

    return F.transform(_part(_c(text), 0), one)


def valid(text: str | Column) -> Column:
    """Whether every start tag begins a message. A mark replaces each message, lest its removal joins two halves of a tag."""
    return ~F.regexp_replace(_c(text), PATTERN, "\u0001").contains(START)


def is_assistant(role: Column) -> Column:
    return (role == "assistant") | role.startswith("assistant ")


def is_tool(role: Column) -> Column:
    """A role that is none of the standard ones and doesn't begin with assistant."""
    return ~role.isin(*STANDARD) & ~role.startswith("assistant")


def last_final(msgs: Column) -> Column:
    """The content of the last assistant message in channel final or without a channel."""
    own = F.filter(msgs, lambda m: is_assistant(m["role"]) & (m["channel"].isNull() | (m["channel"] == "final")))
    return F.try_element_at(F.transform(own, lambda m: m["content"]), F.lit(-1))


def with_messages(df: DataFrame, text: str, out: str = "__messages") -> DataFrame:
    """``df`` with the parsed messages of ``text`` in a column, so that what is told by them doesn't parse again."""
    return df.withColumn(out, messages(text))


def quality_flags(text: str | Column, parsed: Column | None = None) -> dict[str, Column]:
    """Flags of a text by name; all false or 0 for an invalid text. ``parsed`` are its messages where a column has them."""
    t, m = _c(text), messages(text) if parsed is None else parsed
    ok = valid(t)
    final = F.coalesce(strip(last_final(m)), F.lit(""))
    return {
        "valid": ok,
        "completion_nonempty": ok & (F.length(final) >= 32),
        "has_tool": ok & (t.contains(CALL) | F.exists(m, lambda x: is_tool(x["role"]))),
        "message_count": F.when(ok, F.size(m)).otherwise(0),
        "assistant_count": F.when(ok, F.size(F.filter(m, lambda x: is_assistant(x["role"])))).otherwise(0),
        "ends_with_return": ok & rstrip(t).endswith(RETURN),
    }


def spans(text: str | Column) -> Column:
    """array<struct<start, stop>>: where the contents of assistant messages lie, in characters; empty for an invalid text.

    Positions come from the lengths of what lies before: the text is cut at the messages, and each piece is measured.
    """
    t = _c(text)
    whole = F.regexp_extract_all(t, F.lit(r"(?s)(.*?<\|start\|>.*?<\|message\|>.*?(?:<\|end\|>|<\|call\|>|<\|return\|>))"), F.lit(1))
    rows = F.arrays_zip(whole.alias("w"), _part(t, 1).alias("h"), _part(t, 2).alias("c"), _part(t, 3).alias("d"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,mine:boolean>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        to = acc["at"] + F.length(m["w"])
        stop = to - F.length(m["d"])
        role = F.substring_index(m["h"], CHANNEL, 1)
        span = F.struct((stop - F.length(m["c"])).cast("int").alias("start"), stop.cast("int").alias("stop"), is_assistant(role).alias("mine"))
        return F.struct(to.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    got = F.aggregate(rows, start, step, lambda acc: acc["out"])
    mine = F.transform(F.filter(got, lambda s: s["mine"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    return F.when(valid(t), mine).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))


def render(msgs: Column) -> Column:
    """The text of array<struct<role, channel, content, end_tag>>; the last message without a closing tag of its own gets the return tag."""

    def one(m: Column, i: Column) -> Column:
        last = i == F.size(msgs) - 1
        end = F.coalesce(m["end_tag"], F.when(last, RETURN).otherwise(END))
        head = F.concat(F.lit(START), m["role"], F.coalesce(F.concat(F.lit(CHANNEL), m["channel"]), F.lit("")))
        return F.concat(head, F.lit(MESSAGE), F.coalesce(m["content"], F.lit("")), end)

    return F.array_join(F.transform(msgs, one), "")


def prompt_view(text: str | Column) -> Column:
    """The contents of user messages that aren't blank, joined by blank lines."""
    own = F.filter(messages(text), lambda m: (m["role"] == "user") & (strip(m["content"]) != ""))
    return F.array_join(F.transform(own, lambda m: strip(m["content"])), "\n\n")


def excerpt_view(text: str | Column, most: int = 50_000) -> Column:
    """What the assistant thinks: its messages in channel analysis, else final or none, else any; without calls; cut at ``most`` characters."""
    own = F.filter(messages(text), lambda m: is_assistant(m["role"]) & (m["end_tag"] != CALL) & (strip(m["content"]) != ""))
    pick = lambda test: F.filter(own, test)
    thought = pick(lambda m: m["channel"] == "analysis")
    said = pick(lambda m: m["channel"].isNull() | (m["channel"] == "final"))
    best = F.when(F.size(thought) > 0, thought).when(F.size(said) > 0, said).otherwise(own)
    joined = F.array_join(F.transform(best, lambda m: strip(m["content"])), "\n\n")
    return rstrip(F.substring(joined, 1, most))
