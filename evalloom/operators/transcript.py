"""Transcripts and user intent of records, as array expressions over nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import values
from evalloom.session import ship_package

#: A record as these functions read it; further fields are ignored.
RECORD = (
    "record_id string, group_id string, task_type string, user_input string, "
    "conversation_context array<struct<role: string, content: string>>, "
    "tool_calls array<struct<name: string, arguments: string, result: string, error: string>>, "
    "runtime string, assistant_output string, "
    "events array<struct<sequence: int, type: string, role: string, content: string, call_id: string, name: string, arguments: string, result: string, error: string>>"
)
_ENTRY = "struct<role: string, content: string, name: string, arguments: string, outcome: string, error: string, result: string>"


def _message(role: Column, content: Column) -> Column:
    empty = F.lit(None).cast("string")
    return F.struct(role.alias("role"), content.alias("content"), *[empty.alias(c) for c in ("name", "arguments", "outcome", "error", "result")])


def outcome(error: Column, result: Column) -> Column:
    """A non-null error wins over a result."""
    return F.when(error.isNotNull(), "error_returned").when(result.isNotNull(), "result_returned").otherwise("not_recorded")


def _call(c: Column, error: Column, result: Column) -> Column:
    empty = F.lit(None).cast("string")
    return F.struct(
        empty.alias("role"), empty.alias("content"), c["name"].alias("name"), c["arguments"].alias("arguments"), outcome(error, result).alias("outcome"),
        error.alias("error"), F.when(error.isNull(), result).alias("result"),
    )


def _request() -> Column:
    context = F.transform(F.coalesce("conversation_context", F.array().cast("array<struct<role: string, content: string>>")), lambda m: _message(m["role"], m["content"]))
    return F.concat(context, F.array(_message(F.lit("user"), F.col("user_input"))))


def transcript() -> Column:
    """Messages and tool calls in order, each call with the outcome, error and result of its result; the final output last."""
    events = F.array_sort("events")
    kept = F.filter(events, lambda e: e["type"].isin("message", "tool_call"))

    def entry(e: Column) -> Column:
        result = F.try_element_at(F.filter("events", lambda r: (r["type"] == "tool_result") & (r["call_id"] == e["call_id"])), F.lit(-1))
        return F.when(e["type"] == "message", _message(e["role"], e["content"])).otherwise(_call(e, result["error"], result["result"]))

    episode = F.transform(kept, entry)
    has_user = F.exists("events", lambda e: (e["type"] == "message") & (e["role"] == "user"))
    plain = F.concat(_request(), F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<name: string, arguments: string, result: string, error: string>>")), lambda c: _call(c, c["error"], c["result"])))
    body = F.when(F.col("events").isNull(), plain).when(has_user, episode).otherwise(F.concat(_request(), episode))
    last = F.try_element_at(body, F.lit(-1))
    final = F.col("assistant_output")
    stands = F.coalesce((last["role"] == "assistant") & (last["content"] == final), F.lit(False))
    return F.when(final.isNull() | (final == "") | stands, body).otherwise(F.concat(body, F.array(_message(F.lit("assistant"), final)))).cast(f"array<{_ENTRY}>")


def episode_views(records: DataFrame, keep: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Records as a model sees them: (record_id, route, task_type, transcript, runtime), JSON values bounded, results cut down
    by the key rules. ``records`` have a ``route`` (see ``route``). Open values are compacted batch by batch."""
    ship_package(records.sparkSession)
    rows = records.select("record_id", "route", "task_type", transcript().alias("transcript"), F.coalesce("runtime", F.lit("{}")).alias("runtime"))
    return rows.mapInArrow(values.compact_transcripts(keep, drop), rows.schema)


def observed(records: DataFrame, observe_traces: bool = False, keep: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Views of the train records that lessons are taken from, with the feedback of labeled ones; unlabeled ones only with
    ``observe_traces``."""
    chosen = records.filter((F.col("split") == "train") & (F.col("labeled") | F.lit(observe_traces)))
    told = chosen.select("record_id", F.when(F.col("labeled"), F.col("feedback")).alias("feedback"))
    return episode_views(chosen, keep, drop).join(told, "record_id")


def user_messages() -> Column:
    """User contents, trimmed and not empty: those of the episode if it has any, else context and input."""
    told = F.transform(F.filter(F.array_sort("events"), lambda e: (e["type"] == "message") & (e["role"] == "user")), lambda e: F.trim(e["content"]))
    context = F.transform(F.filter("conversation_context", lambda m: m["role"] == "user"), lambda m: F.trim(m["content"]))
    asked = F.concat(F.coalesce(context, F.array().cast("array<string>")), F.array(F.trim("user_input")))
    found = F.when(F.size("events") > 0, F.when(F.size(told) > 0, told).otherwise(asked)).otherwise(asked)
    return F.filter(found, lambda t: t != "")


def user_intent() -> Column:
    return F.array_join(user_messages(), "\n")


def tool_names() -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter("events", lambda e: e["type"] == "tool_call"), lambda e: e["name"])))


def route(raw: str) -> Column:
    """The route where the KEY is present in the raw JSON, null or not; else the task type."""
    return F.when(F.array_contains(F.json_object_keys(raw), "route"), F.get_json_object(raw, "$.route")).otherwise(F.get_json_object(raw, "$.task_type"))


def node_context(context: Column, steps: Column) -> Column:
    """Context entries and ``steps.<name>.output`` of every step in one map."""
    outputs = F.map_from_entries(F.transform(steps, lambda s: F.struct(F.concat(F.lit("steps."), s["name"], F.lit(".output")), s["output"])))
    return F.map_concat(context, outputs)


def dialogue(turns: DataFrame, case: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per case: user texts and the last assistant text that is not blank."""
    said = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("text"))))
    each = turns.groupBy(case).agg(said.alias("said"))

    def texts(name: str) -> Column:
        return F.transform(F.filter("said", lambda s: (s["role"] == name) & (F.trim(s["text"]) != "")), lambda s: F.trim(s["text"]))

    return each.select(case, F.array_join(texts("user"), "\n").alias("intent"), F.try_element_at(texts("assistant"), F.lit(-1)).alias("last_assistant"), F.size("said").cast("long").alias("turns"))
