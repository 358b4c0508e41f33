"""Contracts of records, episodes, lessons and scores, as columns of violation codes.

A code is null for a row that holds its contract; otherwise it names the first rule that the row
breaks, in the order in which rules are listed. Rows are kept, so callers choose between failing
(``sources.records.fail_on``) and setting rows aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import values
from evalloom.functions.text import blank

# Fixed values of the contracts.
POLARITIES = ("positive", "negative", "mixed")
SIGNAL_KINDS = ("deterministic", "executable")
EVENT_TYPES = ("message", "tool_call", "tool_result")
LESSON_TYPES = ("failure", "success", "improvement")
LESSON_SIGNALS = ("explicit", "clear", "weak")
CRITERION_KINDS = ("required", "prohibited", "preferred")
SEVERITIES = ("critical", "major", "minor")
MIN_QUOTE, MIN_FRAGMENT = 8, 3
REQUIRED_FIELDS = (
    "schema_version", "record_id", "group_id", "task_type", "user_input", "conversation_context", "tool_calls", "runtime", "metadata",
)


def first_code(*rules: tuple[str, Column]) -> Column:
    """Code of the first rule whose condition holds; a condition that is null does not."""
    return F.coalesce(*[F.when(condition, F.lit(code)) for code, condition in rules])


def episode_code(events: Column) -> Column:
    """First broken rule of an episode's events, by a fold that carries the open and answered calls."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(-1).alias("seq"), none.alias("called"), none.alias("done"), F.lit(None).cast("string").alias("code"))

    def step(s: Column, e: Column) -> Column:
        call, result = e["type"] == "tool_call", e["type"] == "tool_result"
        code = first_code(
            ("sequence_not_increasing", e["sequence"].isNull() | (e["sequence"] <= s["seq"])),
            ("event_type", e["type"].isNull() | ~e["type"].isin(*EVENT_TYPES)),
            ("message_fields", (e["type"] == "message") & (blank(e["role"]) | blank(e["content"]))),
            ("call_id", (call | result) & blank(e["call_id"])),
            ("duplicate_call", call & F.array_contains(s["called"], e["call_id"])),
            ("call_name", call & blank(e["name"])),
            ("result_without_call", result & ~F.array_contains(s["called"], e["call_id"])),
            ("second_result", result & F.array_contains(s["done"], e["call_id"])),
            ("empty_result", result & e["result"].isNull() & e["error"].isNull()),
        )
        return F.struct(
            F.coalesce(e["sequence"], s["seq"]).alias("seq"),
            F.when(call, F.array_append(s["called"], e["call_id"])).otherwise(s["called"]).alias("called"),
            F.when(result, F.array_append(s["done"], e["call_id"])).otherwise(s["done"]).alias("done"),
            F.coalesce(s["code"], code).alias("code"),
        )

    folded = F.aggregate(events, start, step, lambda s: s["code"])
    return F.when(events.isNotNull(), F.when(F.size(events) == 0, "no_events").otherwise(folded))


def record_code(labeled: bool) -> Column:
    """Rules of an input record (``operators.transcript.RECORD`` plus ``feedback`` with polarity and signals)."""
    texts = [(f"blank_{c}", blank(F.col(c))) for c in ("record_id", "group_id", "task_type", "user_input")]
    calls = F.exists("tool_calls", lambda c: blank(c["name"]) | c["arguments"].isNull())
    messages = F.exists("conversation_context", lambda m: blank(m["role"]) | blank(m["content"]))
    polarity = F.col("feedback.polarity")
    if labeled:
        signals = F.exists("feedback.signals", lambda s: s["kind"].isNull() | ~s["kind"].isin(*SIGNAL_KINDS) | blank(s["check_id"]) | s["passed"].isNull())
        feedback = [("no_feedback", F.col("feedback").isNull()), ("polarity", polarity.isNull() | ~polarity.isin(*POLARITIES)), ("correctness_signal", signals)]
    else:
        feedback = [("unexpected_feedback", F.col("feedback").isNotNull())]
    return F.coalesce(first_code(*texts, ("context_message", messages), ("tool_call", calls), *feedback), episode_code(F.col("events")))


def raw_record_code(raw: Column, labeled: bool, version: str) -> Column:
    """Rules of an input record that only its JSON text shows: missing keys, types, and keys that are there but null.

    A field that may be left out (request_id, route) must not be blank where it is there; labeled records have their
    ``assistant_output`` and feedback, others no feedback; a tool result has a ``result`` key, null or not, or an error.
    """
    v = F.try_parse_json(raw)
    fields = F.try_variant_get(v, "$", "map<string, variant>")

    def has(name: str) -> Column:
        return F.map_contains_key(fields, F.lit(name))

    def kind(name: str) -> Column:
        return F.schema_of_variant(fields[name])

    def text(name: str) -> Column:
        return F.when(kind(name) == "STRING", F.try_variant_get(fields[name], "$", "string"))

    missing = F.array_except(F.array(*map(F.lit, REQUIRED_FIELDS)), F.map_keys(fields))
    events = F.try_variant_get(v, "$.episode.events", "array<map<string, variant>>")

    def unanswered(e: Column) -> Column:
        result = F.try_variant_get(e["type"], "$", "string") == "tool_result"
        error = F.map_contains_key(e, F.lit("error")) & ~F.is_variant_null(e["error"])
        return result & ~F.map_contains_key(e, F.lit("result")) & ~error

    rules = [
        ("not_an_object", fields.isNull()),
        ("missing_field", F.size(missing) > 0),
        ("schema_version", ~text("schema_version").eqNullSafe(F.lit(version))),
        *[(f"blank_{c}", blank(text(c))) for c in ("record_id", "group_id", "task_type", "user_input")],
        *[(c, has(c) & blank(text(c))) for c in ("request_id", "route")],
        ("assistant_output", has("assistant_output") & text("assistant_output").isNull()),
        *[(c, ~kind(c).startswith("ARRAY")) for c in ("conversation_context", "tool_calls")],
        ("empty_result", F.exists(events, unanswered)),
        *[(c, ~kind(c).startswith("OBJECT")) for c in ("runtime", "metadata")],
    ]
    if labeled:
        rules += [("no_assistant_output", ~has("assistant_output")), ("no_feedback", ~F.coalesce(kind("feedback").startswith("OBJECT"), F.lit(False)))]
    else:
        rules.append(("unexpected_feedback", has("feedback")))
    return first_code(*rules)


def held_out_lessons(lessons: DataFrame, records: DataFrame) -> DataFrame:
    """Lessons (lesson_id, record_id) that come from a record outside the train split, or from none; none where nothing leaks."""
    train = records.filter("split = 'train'").select("record_id")
    return lessons.join(train, "record_id", "left_anti").select("lesson_id", "record_id")


def protected_rows(rows: DataFrame, raw: str, protected: tuple[str, ...]) -> DataFrame:
    """Rows whose JSON text has one of the protected keys at any depth."""
    return rows.filter(F.arrays_overlap(values.nested_keys(raw), F.array(*map(F.lit, protected))))


def parameter_value_code(value: Column, kind: str, low: float | None = None, high: float | None = None, choices: tuple[str, ...] = ()) -> Column:
    """Rule that a variant breaks as the value of a parameter of this kind: bool, choice, int or float."""
    of, number = F.schema_of_variant(value), F.try_variant_get(value, "$", "double")
    if kind == "bool":
        return F.when(of.isNull() | (of != "BOOLEAN"), "not_bool")
    if kind == "choice":
        return F.when(~F.coalesce(F.try_variant_get(value, "$", "string").isin(*choices), F.lit(False)), "not_a_choice")
    numeric = of.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL.*)$")
    return first_code(
        ("not_numeric", of.isNull() | ~numeric), ("not_int", (number != F.floor(number)) if kind == "int" else F.lit(False)),
        ("below_minimum", number < low if low is not None else F.lit(False)), ("above_maximum", number > high if high is not None else F.lit(False)),
    )


def record_violations(records: DataFrame, labeled: bool) -> DataFrame:
    """(record_id, code) of all records that break the contract or repeat an id."""
    own = records.select("record_id", record_code(labeled).alias("code")).filter("code is not null")
    repeated = records.groupBy("record_id").count().filter("count > 1").select("record_id", F.lit("duplicate_record_id").alias("code"))
    return own.unionByName(repeated)


def missing_fields(raw: str) -> Column:
    """Required fields whose KEY a raw JSON record lacks."""
    return F.array_except(F.array(*map(F.lit, REQUIRED_FIELDS)), F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")))


def quote_found(quote: Column, values: Column) -> Column:
    """Whether a quote stands in one of the text values: its fragments between ellipses in order, white space and
    case aside; eight characters at least, three in each fragment."""
    plain = F.lower(F.regexp_replace(quote, r"\s+", " "))
    parts = F.filter(F.transform(F.split(plain, r"\.\.\.|…"), lambda p: F.trim(p, F.lit(" \"'“”‘’"))), lambda p: p != "")
    total = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
    quoted = F.transform(parts, lambda p: F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("")), F.lit("\\E")))
    pattern = F.concat(F.lit("(?s)"), F.array_join(quoted, ".*?"))
    held = F.exists(values, lambda v: F.regexp_like(F.lower(F.regexp_replace(v, r"\s+", " ")), pattern))
    return (total >= MIN_QUOTE) & ~F.exists(parts, lambda p: F.length(p) < MIN_FRAGMENT) & held


LESSON = "type string, lesson string, signal string, confidence double, knowable boolean, evidence array<struct<source string, text string>>"


def check_lessons(lessons: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Lessons (``LESSON`` with ``feedback_values`` and ``trace_values``, arrays of texts) with ``reason``, null
    where kept, the verified ``evidence``, and the ``signal`` lowered to clear without a feedback quote."""
    found = F.filter(
        "evidence",
        lambda q: F.when(q["source"] == "feedback", quote_found(q["text"], F.col("feedback_values"))).otherwise(quote_found(q["text"], F.col("trace_values"))),
    )
    unit = F.col("confidence").between(0, 1)
    malformed = (
        F.col("type").isNull() | ~F.col("type").isin(*LESSON_TYPES) | blank(F.col("lesson")) | F.col("signal").isNull()
        | ~F.col("signal").isin(*LESSON_SIGNALS) | F.col("confidence").isNull() | ~unit | F.col("evidence").isNull()
        | F.exists("evidence", lambda q: q["source"].isNull() | ~q["source"].isin("feedback", "trace") | blank(q["text"]))
    )
    checked = lessons.withColumn("verified", found)
    reason = first_code(
        ("malformed", malformed),
        ("needs_hindsight", ~F.coalesce("knowable", F.lit(False))),
        ("low_confidence", F.col("confidence") < min_confidence),
        ("unverified_evidence", F.size("verified") == 0),
    )
    told = F.exists("verified", lambda q: q["source"] == "feedback")
    signal = F.when((F.col("signal") == "explicit") & ~told, "clear").otherwise(F.col("signal"))
    return checked.withColumns({"reason": reason, "signal": signal, "evidence": F.col("verified")}).drop("verified")


def number_code(value: Column, maximum: float | None = None) -> Column:
    """Rule that a score's text breaks: a finite number from 0 on; numeric text passes, booleans do not."""
    n = value.try_cast("double")
    over = n > maximum if maximum is not None else F.lit(False)
    return first_code(("not_numeric", n.isNull()), ("not_finite", F.isnan(n) | (F.abs(n) == float("inf"))), ("out_of_range", (n < 0) | over))


def score_code(score: Column, breakdown: Column) -> Column:
    """First broken rule of a scorer's result: a composite from 0 to 100, named parts from 0 on."""
    parts = F.transform(F.map_entries(breakdown), lambda e: F.when(e["key"] == "", "unnamed_part").otherwise(number_code(e["value"])))
    return F.coalesce(number_code(score, 100.0), F.when(breakdown.isNull(), "no_breakdown"), F.get(F.array_compact(parts), F.lit(0)))


def rubric_guidelines(chosen: Column, known: Column) -> Column:
    """Guideline ids that a rubric chose, in order and once; a criterion's id stands for its guideline."""
    return F.array_distinct(F.transform(chosen, lambda c: F.when(F.array_contains(known, c), c).otherwise(F.substring_index(c, ".", 1))))


def split_leaks(records: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups that more than one split holds; none where a split leaks nothing."""
    return records.groupBy(group).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def parameter_code(value: Column, low: Column, high: Column, current: Column) -> Column:
    """Rule that a proposed parameter value breaks; null bounds mean that the parameter is not in the space."""
    return first_code(("parameter_scope", low.isNull()), ("parameter_bounds", (value < low) | (value > high)), ("no_change", value == current))
