"""Model replies as tables: what a recorded reply says, and the first rule that it breaks.

A reply is a JSON text. Its codes are null where it holds its contract; parsers return rows for what it says, so that
callers can ask again for the replies with a code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import blank, json_object, strip
from evalloom.operators.validation import CRITERION_KINDS, SEVERITIES, first_code, rubric_guidelines

# The fields of a memory card, scopes of plans, verdicts of a review, and what is said of lessons that no
# reply accounts for.
CARD_TEXTS, CARD_LISTS = ("title", "summary"), ("when_to_use", "when_not_to_use")
CARD_ITEMS = {"instructions": "source_criterion_ids", "avoid": "source_criterion_ids", "tool_guidance": "source_criterion_ids", "example_steps": "source_trace_ids"}
PLAN_SCOPES = ("edit", "rewrite")
VERDICTS = ("pass", "warn", "fail")
UNADDRESSED = "not addressed by the model"

_ITEMS, _MAP = "array<variant>", "map<string, variant>"
CRITERION = "struct<kind: string, statement: string, applicability: string, severity: string, scoring: string>"


def choice_code(value: Column, options: tuple[str, ...]) -> Column:
    return F.when(value.isNull() | ~value.isin(*options), "choice")


def text_code(value: Column) -> Column:
    return F.when(blank(value), "blank")


def unit_code(value: Column) -> Column:
    """Code of a variant that is no number from 0 to 1; booleans and texts are none."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return first_code(("not_numeric", kind.isNull() | kind.isin("BOOLEAN", "STRING", "VOID") | number.isNull()), ("not_unit", ~number.between(0, 1)))


def criteria_code(criteria: Column, require: bool) -> Column:
    """First broken rule of an array of ``CRITERION``."""

    def wrong(c: Column) -> Column:
        return first_code(
            ("kind", choice_code(c["kind"], CRITERION_KINDS).isNotNull()), ("severity", choice_code(c["severity"], SEVERITIES).isNotNull()),
            *[(f, blank(c[f])) for f in ("statement", "applicability", "scoring")],
        )

    empty = F.when(F.size(criteria) == 0, "no_criteria") if require else F.lit(None).cast("string")
    return F.coalesce(F.when(criteria.isNull(), "criteria"), F.get(F.array_compact(F.transform(criteria, wrong)), F.lit(0)), empty)


def _texts(value: Column, path: str) -> Column:
    """Scalars of a list as texts."""
    return F.try_variant_get(value, path, "array<string>")


def observations(requests: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lessons, codes) of replies (batch, raw) to requests (batch, record_id).

    ``lessons`` is (batch, record_id, pos, lesson) of sound replies; a code (batch, code) says that a reply names a record that
    was not asked for or names one twice, has no list of lessons for one, or leaves one out.
    """
    body = F.try_parse_json("raw")
    read = replies.select("batch", F.try_variant_get(body, "$.episodes", _ITEMS).alias("episodes"))
    told = read.select("batch", F.posexplode("episodes").alias("at", "e")).select(
        "batch", "at", F.try_variant_get("e", "$.record_id", "string").alias("record_id"), F.try_variant_get("e", "$.lessons", _ITEMS).alias("lessons")
    )
    both = told.join(requests.withColumn("asked", F.lit(True)), ["batch", "record_id"], "full_outer")
    again = F.count("at").over(Window.partitionBy("batch", "record_id")) > 1
    code = first_code(("unexpected_record", F.col("asked").isNull() | again), ("lessons_not_list", F.col("at").isNotNull() & F.col("lessons").isNull()), ("missing_record", F.col("at").isNull()))
    rows = both.withColumn("code", code)
    broken = read.filter("episodes is null").select("batch", F.lit("episodes_not_list").alias("code"))
    order = F.struct(F.col("code") == "missing_record", "at")
    first = rows.filter("code is not null").groupBy("batch").agg(F.min_by("code", order).alias("code")).join(broken.select("batch"), "batch", "left_anti")
    codes = first.unionByName(broken)
    sound = rows.filter("code is null").join(codes.select("batch"), "batch", "left_anti")
    return sound.select("batch", "record_id", F.posexplode("lessons").alias("pos", "lesson")), codes


def synthesis(lessons: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(guidelines, placed, codes) of replies (route, raw) about lessons (route, lesson_id).

    ``guidelines`` is (route, pos, title, dividing_line, criteria, lesson_ids); ``placed`` says for every lesson (route,
    lesson_id, place, reason) whether a guideline, ``cannot_fix`` or ``set_aside`` accounts for it; those that none does are
    set aside with a reason. ``codes`` (route, code) are broken rules: unknown lessons, guidelines without lessons, criteria or
    text.
    """
    read = replies.select("route", F.try_parse_json("raw").alias("v"))
    each = read.select("route", F.posexplode(F.try_variant_get("v", "$.guidelines", _ITEMS)).alias("pos", "g"))
    guidelines = each.select(
        "route", "pos", strip(F.try_variant_get("g", "$.title", "string")).alias("title"), strip(F.try_variant_get("g", "$.dividing_line", "string")).alias("dividing_line"),
        F.try_variant_get("g", "$.criteria", f"array<{CRITERION}>").alias("criteria"), _texts(F.col("g"), "$.lesson_ids").alias("lesson_ids"),
    )
    own = first_code(("no_lessons", F.col("lesson_ids").isNull() | (F.size("lesson_ids") == 0)), ("title", blank(F.col("title"))), ("dividing_line", blank(F.col("dividing_line"))))
    codes = guidelines.select("route", F.coalesce(own, criteria_code(F.col("criteria"), True)).alias("code")).filter("code is not null")
    cited = [guidelines.select("route", F.explode("lesson_ids").alias("lesson_id"), F.lit("guideline").alias("place"), F.lit(None).cast("string").alias("reason"))]
    for name in ("cannot_fix", "set_aside"):
        item = read.select("route", F.explode(F.try_variant_get("v", f"$.{name}", _ITEMS)).alias("i"))
        reason = strip(F.try_variant_get("i", "$.reason", "string"))
        cited.append(item.select("route", F.explode(_texts(F.col("i"), "$.lesson_ids")).alias("lesson_id"), F.lit(name).alias("place"), reason.alias("reason")))
    named = cited[0].unionByName(cited[1]).unionByName(cited[2])
    unknown = named.join(lessons.select("route", "lesson_id"), ["route", "lesson_id"], "left_anti").select("route", F.lit("unknown_lesson").alias("code"))
    rank = F.when(F.col("place") == "guideline", 0).when(F.col("place") == "cannot_fix", 1).otherwise(2)
    once = named.groupBy("route", "lesson_id").agg(F.min_by(F.struct("place", "reason"), F.struct(rank, "reason")).alias("p"))
    placed = lessons.select("route", "lesson_id").join(once, ["route", "lesson_id"], "left")
    placed = placed.select("route", "lesson_id", F.coalesce("p.place", F.lit("set_aside")).alias("place"), F.when(F.col("p").isNull(), UNADDRESSED).otherwise(F.col("p.reason")).alias("reason"))
    return guidelines, placed, codes.unionByName(unknown).distinct()


def plans(replies: DataFrame, levels: list[str], modules: list[str], space: dict[str, tuple[float, float]], most: int = 1) -> DataFrame:
    """(reply_id, pos, level, module, scope, technique, hypothesis, changes, code): the plans of replies (reply_id, raw),
    equal ones once and the first ``most`` of each reply; ``pos`` counts plans as they were given.

    A prompt plan names one of ``modules`` and a scope; other plans change parameters within ``space`` (path to bounds).
    """
    body = F.try_parse_json("raw")
    listed = F.try_variant_get(body, "$.plans", _ITEMS)
    single = F.array_compact(F.array(F.try_variant_get(body, "$.plan", "variant")))
    each = replies.select("reply_id", F.posexplode(F.coalesce(listed, single)).alias("pos", "p"))

    def field(name: str) -> Column:
        return strip(F.try_variant_get("p", f"$.{name}", "string"))

    prompt = F.col("level") == "prompt"
    rows = each.select("reply_id", "pos", *[field(c).alias(c) for c in ("level", "module", "scope", "technique", "hypothesis")], F.try_variant_get("p", "$.parameter_changes", _MAP).alias("c"))
    rows = rows.withColumns({"module": F.when(prompt, F.col("module")), "scope": F.when(prompt, F.coalesce("scope", F.lit("edit"))).otherwise("edit"), "c": F.when(~prompt, F.col("c"))})

    def outside(e: Column) -> Column:
        value = F.try_variant_get(e["value"], "$", "double")
        known = F.lit(False)
        for name, (low, high) in space.items():
            known = known | ((e["key"] == name) & value.between(low, high))
        return ~F.coalesce(known, F.lit(False))

    code = first_code(
        ("level", F.col("level").isNull() | ~F.col("level").isin(*levels)),
        ("technique", blank(F.col("technique"))),
        ("hypothesis", blank(F.col("hypothesis"))),
        ("module", prompt & (F.col("module").isNull() | ~F.col("module").isin(*modules))),
        ("scope", prompt & ~F.col("scope").isin(*PLAN_SCOPES)),
        ("parameter_changes", ~prompt & F.col("c").isNull()),
        ("parameter_bounds", ~prompt & F.exists(F.map_entries("c"), outside)),
    )
    rows = rows.withColumn("code", code).withColumn("changes", F.to_json("c")).drop("c")
    same = Window.partitionBy("reply_id", "level", "module", "scope", "technique", "hypothesis", "changes").orderBy("pos")
    once = rows.withColumn("n", F.row_number().over(same)).filter("n = 1").drop("n")
    kept = once.withColumn("n", F.row_number().over(Window.partitionBy("reply_id").orderBy("pos"))).filter(F.col("n") <= most)
    return kept.select("reply_id", "pos", "level", "module", "scope", "technique", "hypothesis", "changes", "code")


def review_issues(replies: DataFrame) -> DataFrame:
    """(reply_id, verdict, check, severity): issues of reviews (reply_id, raw); a review that fails without a blocking issue
    gets one. A verdict that is none of the three is an issue ``verdict`` of severity ``invalid``."""
    body = F.try_parse_json("raw")
    read = replies.select("reply_id", F.try_variant_get(body, "$.verdict", "string").alias("verdict"), F.coalesce(F.try_variant_get(body, "$.issues", _ITEMS), F.array().cast(_ITEMS)).alias("i"))
    severity = lambda i: F.when(F.try_variant_get(i, "$.severity", "string") == "block", "block").otherwise("warn")
    found = F.transform("i", lambda i: F.struct(F.concat(F.lit("llm_"), F.coalesce(F.try_variant_get(i, "$.check", "string"), F.lit("review"))).alias("check"), severity(i).alias("severity")))
    added = F.array(F.struct(F.lit("llm_review").alias("check"), F.lit("block").alias("severity")))
    odd = F.array(F.struct(F.lit("verdict").alias("check"), F.lit("invalid").alias("severity")))
    issues = (
        F.when(F.col("verdict").isNull() | ~F.col("verdict").isin(*VERDICTS), odd)
        .when((F.col("verdict") == "fail") & ~F.exists("found", lambda x: x["severity"] == "block"), F.concat("found", added))
        .otherwise(F.col("found"))
    )
    return read.withColumn("found", found).select("reply_id", "verdict", F.inline(issues))


def list_code(value: Column, required: bool = False) -> Column:
    """Code of a variant that is no list of texts, has a blank one, repeats one, or is empty though required."""
    kind, texts = F.schema_of_variant(value), F.transform(F.try_variant_get(value, "$", "array<string>"), strip)
    empty = F.size(texts) == 0
    return first_code(
        ("not_list", kind.isNull() | ~kind.startswith("ARRAY") | ~kind.rlike(r"^ARRAY<(STRING|VOID)?>$")),
        ("blank", F.exists(texts, blank)),
        ("empty", empty if required else F.lit(False)),
        ("duplicates", F.size(F.array_distinct(texts)) < F.size(texts)),
    )


def _wrong_item(citation: str, known: Column, trace_ids: Column) -> Callable[[Column], Column]:
    """Whether an item has no text, other fields, or citations that are no list or unknown."""

    def wrong(i: Column) -> Column:
        item = F.try_variant_get(i, "$", _MAP)
        cited, traces = _texts(i, f"$.{citation}"), _texts(i, "$.source_trace_ids")
        allowed = F.array(F.lit("text"), F.lit(citation), F.lit("source_trace_ids"))
        return F.coalesce(
            item.isNull() | blank(F.try_variant_get(i, "$.text", "string")) | (F.size(F.array_except(F.map_keys(item), allowed)) > 0)
            | list_code(item[citation], True).isNotNull() | (F.size(F.array_except(cited, known)) > 0)
            | (traces.isNotNull() & (F.size(F.array_except(traces, trace_ids)) > 0)),
            F.lit(True),
        )

    return wrong


def card_code(reply: Column, criterion_ids: Column, trace_ids: Column) -> Column:
    """First broken rule of a reply with a memory card (a variant): its eight fields, texts, lists, and items that cite known
    criteria or traces only."""
    card = F.try_variant_get(reply, "$.memory_card", _MAP)
    fields = (*CARD_TEXTS, *CARD_LISTS, *CARD_ITEMS)
    rules = [
        ("memory_card", card.isNull() | (F.size(F.try_variant_get(reply, "$", _MAP)) != 1)),
        ("fields", F.array_sort(F.map_keys(card)) != F.array(*map(F.lit, sorted(fields)))),
        *[(f, blank(F.try_variant_get(card[f], "$", "string"))) for f in CARD_TEXTS],
        ("when_to_use", list_code(card["when_to_use"], True).isNotNull()),
        ("when_not_to_use", list_code(card["when_not_to_use"]).isNotNull()),
    ]
    for f, citation in CARD_ITEMS.items():
        items = F.try_variant_get(card[f], "$", _ITEMS)
        short = F.size(items) == 0 if f == "instructions" else F.lit(False)
        wrong = _wrong_item(citation, trace_ids if citation == "source_trace_ids" else criterion_ids, trace_ids)
        rules.append((f, items.isNull() | short | F.exists(items, wrong)))
    return first_code(*rules)


def judge_verdict(raw: Column) -> Column:
    """Score (0 to 100) and reason of a judge's reply; null without a JSON object or a score."""
    v = json_object(raw)
    score = F.try_variant_get(v, "$.score", "double")
    reason = F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit(""))
    return F.when(score.isNotNull(), F.struct(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"), reason.alias("reason")))


def judge_criteria(raw: Column) -> Column:
    """Verdicts by criterion of a judge's reply; null where it has no list of them."""
    return F.try_variant_get(json_object(raw), "$.criteria", "array<struct<criterion_id: string, status: string, evidence: string>>")


def rubric_code(raw: Column, known: Column) -> Column:
    """First broken rule of a rubric reply: guideline ids (a criterion's stands for its guideline) that are all ``known``, criteria, tool
    expectations that are an object, a reference that is a text, and a confidence from 0 to 1."""
    v = F.try_parse_json(raw)
    fields = F.try_variant_get(v, "$", _MAP)
    chosen = rubric_guidelines(_texts(v, "$.applicable_guideline_ids"), known)
    tools, reference = fields["tool_expectations"], fields["reference_output"]
    return F.coalesce(
        first_code(
            ("not_an_object", fields.isNull()), ("guideline_ids", chosen.isNull()), ("unknown_guideline", F.size(F.array_except(chosen, known)) > 0),
            ("tool_expectations", tools.isNotNull() & ~F.is_variant_null(tools) & ~F.schema_of_variant(tools).startswith("OBJECT")),
            ("reference_output", reference.isNotNull() & ~F.is_variant_null(reference) & (F.schema_of_variant(reference) != "STRING")),
        ),
        criteria_code(F.try_variant_get(v, "$.case_criteria", f"array<{CRITERION}>"), False),
        F.when(unit_code(fields["confidence"]).isNotNull(), "confidence"),
    )
