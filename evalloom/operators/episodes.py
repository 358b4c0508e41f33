"""Recorded simulations as episodes: sequenced events, linked calls and the dialogue's ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import blank
from evalloom.operators.validation import episode_code, first_code

SIMULATION = (
    "id string, task_id string, trial int, seed int, termination_reason string, "
    "messages array<struct<role: string, content: string, id: string, error: boolean, tool_calls: array<struct<id: string, name: string, arguments: string>>>>"
)
EVENT = "struct<sequence: int, type: string, role: string, content: string, call_id: string, name: string, arguments: string, result: string, error: string>"


def _event(kind: str, role=None, content=None, call=None, name=None, arguments=None, result=None, error=None) -> Column:
    empty = F.lit(None).cast("string")
    parts = {"role": role, "content": content, "call_id": call, "name": name, "arguments": arguments, "result": result, "error": error}
    return F.struct(F.lit(0).alias("sequence"), F.lit(kind).alias("type"), *[(empty if v is None else v).alias(k) for k, v in parts.items()]).cast(EVENT)


def events() -> Column:
    """Events of ``messages`` in order: a text, then its calls, or a call's result; numbered from 0."""

    def of(m: Column) -> Column:
        text = F.filter(F.array(_event("message", m["role"], m["content"])), lambda e: ~blank(e["content"]))
        calls = F.transform(F.coalesce(m["tool_calls"], F.array().cast("array<struct<id: string, name: string, arguments: string>>")), lambda c: _event("tool_call", call=c["id"], name=c["name"], arguments=c["arguments"]))
        failed = F.coalesce(m["error"], F.lit(False))
        result = _event("tool_result", call=m["id"], result=F.when(~failed, m["content"]), error=F.when(failed, m["content"]))
        return F.when(m["role"] == "tool", F.array(result)).otherwise(F.concat(text, calls))

    flat = F.flatten(F.transform("messages", of))
    return F.transform(flat, lambda e, i: F.struct(i.alias("sequence"), *[e[c].alias(c) for c in ("type", "role", "content", "call_id", "name", "arguments", "result", "error")]))


def episodes(simulations: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row per simulation (``SIMULATION``): its record id, partition, events, request, dialogue before it, last assistant
    text, and ``code``, the first rule that it breaks. ``assignments`` has task_id, partition and group_id."""
    speech = F.filter("messages", lambda m: m["role"].isin("assistant", "user") & ~blank(m["content"]))
    first = F.array_position(F.transform("messages", lambda m: F.coalesce(m["role"] == "user", F.lit(False))), True).cast("int")
    before = F.filter(F.slice("messages", F.lit(1), F.greatest(first - 1, F.lit(0))), lambda m: m["role"].isin("assistant", "user") & ~blank(m["content"]))
    last = F.try_element_at(F.filter(speech, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    rows = simulations.join(assignments, "task_id", "left").withColumn("events", events())
    asked = F.size(F.filter("events", lambda e: e["type"] == "tool_call"))
    told = F.size(F.filter("events", lambda e: e["type"] == "tool_result"))
    code = first_code(
        ("no_messages", F.col("messages").isNull() | (F.size("messages") == 0)),
        ("role", F.exists("messages", lambda m: m["role"].isNull() | ~m["role"].isin("assistant", "user", "tool"))),
        ("unassigned_task", F.col("partition").isNull()),
        ("no_user_message", first == 0),
        ("no_assistant_text", last.isNull()),
        ("termination", blank(F.col("termination_reason"))),
    )
    unanswered = F.when(asked != told, "unanswered_call")
    return rows.select(
        F.concat_ws("-", F.lit("task"), "task_id", F.lit("trial"), F.col("trial").cast("string")).alias("record_id"),
        "group_id", "partition", "events",
        F.try_element_at("messages", F.when(first > 0, first))["content"].alias("user_input"),
        F.transform(before, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("conversation_context"),
        last.alias("assistant_output"),
        F.coalesce(code, episode_code(F.col("events")), unanswered).alias("code"),
    )
