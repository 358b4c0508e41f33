"""Attribution of failed cases to steps by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.scores import retrieval_overlap, retrieval_tier
from evalloom.functions.text import blank, classify_tool_error, is_retrieval_step

# Heuristics by what can address them; all others can be addressed by prompts (or skills).
TOOL = "tool_failure_"
STRUCTURAL = ("retrieval_empty", "retrieval_overlap", "cascade")


def attribute(cases: DataFrame, threshold: float = 100.0) -> DataFrame:
    """(case_id, pos, step, heuristic, confidence, tier) of every failed case.

    ``cases`` has case_id, failed_execution (boolean), score, steps (array of structs name and
    output, in order), question, expected and tool_error (struct tool and message of the first failed
    call, or null). The first rule that fits decides: execution failure, no steps, tool failure,
    cascade (which also tags all later steps), retrieval, empty intermediate output, format, last step.
    """
    steps, last = F.col("steps"), F.size("steps") - 1
    empty = F.transform(steps, lambda s: blank(s["output"]))
    base = cases.filter(F.col("failed_execution") | (F.coalesce("score", F.lit(0.0)) < threshold)).withColumn("empty", empty)
    at = F.sequence(F.lit(0), F.size("steps") - 1)
    root = F.array_min(
        F.filter(at, lambda i: (i < last) & F.get("empty", i) & F.exists(F.slice("empty", i + 2, F.size("empty")), lambda e: e))
    )
    graded = F.transform(
        steps,
        lambda s: F.when(
            is_retrieval_step(s["name"]), F.when(blank(s["output"]), -1.0).otherwise(retrieval_overlap(F.col("question"), s["output"]))
        ),
    )
    base = base.withColumn("root", F.when(F.size("steps") >= 2, root)).withColumn("graded", graded)
    weak = F.array_min(F.filter(at, lambda i: F.get("graded", i) < 0.4))
    hollow = F.array_min(F.filter(at, lambda i: (i < last) & F.get("empty", i)))
    base = base.withColumn("weak", F.when(F.size("steps") > 0, weak)).withColumn("hollow", F.when(F.size("steps") > 0, hollow))
    final, answer = F.trim(F.get("steps", last)["output"]), F.trim("expected")
    framed = F.coalesce(
        (answer != "") & (final != answer) & F.contains(F.lower(final), F.lower(answer)) & (F.length(final) > 1.5 * F.length(answer)),
        F.lit(False),
    )

    def found(pos: Column, step: Column, heuristic: Column, confidence: Column, tier: Column | None = None) -> Column:
        tier = F.lit(None).cast("string") if tier is None else tier
        return F.array(
            F.struct(
                pos.cast("int").alias("pos"), step.alias("step"), heuristic.alias("heuristic"),
                confidence.alias("confidence"), tier.alias("tier"),
            )
        )

    def name(i: Column) -> Column:
        return F.get("steps", i)["name"]

    nothing, high = F.lit(None).cast("int"), F.lit("high")
    overlap = F.get("graded", F.col("weak"))
    cascade = F.transform(
        F.slice("steps", F.col("root") + 1, F.size("steps")),
        lambda s, i: F.struct(
            (F.col("root") + i).cast("int").alias("pos"), s["name"].alias("step"),
            F.when(i == 0, "cascade").otherwise("cascade_downstream").alias("heuristic"), high.alias("confidence"),
            F.lit(None).cast("string").alias("tier"),
        ),
    )
    rules = (
        F.when(F.col("failed_execution"), found(nothing, F.lit("__infrastructure__"), F.lit("execution_failure"), high))
        .when(F.size("steps") <= 0, found(nothing, F.lit("__no_steps__"), F.lit("no_steps"), high))
        .when(
            F.col("tool_error").isNotNull(),
            found(
                nothing, F.concat(F.lit("tool_"), F.coalesce("tool_error.tool", F.lit("unknown"))),
                F.concat(F.lit("tool_failure_"), classify_tool_error(F.col("tool_error.message"))), high,
            ),
        )
        .when(F.col("root").isNotNull(), cascade)
        .when(
            F.col("weak").isNotNull(),
            found(
                F.col("weak"), name(F.col("weak")),
                F.when(overlap < 0, "retrieval_empty").otherwise("retrieval_overlap"),
                F.when((overlap < 0.1) | (overlap > 0.35), "high").otherwise("medium"),
                retrieval_tier(overlap),
            ),
        )
        .when(F.col("hollow").isNotNull(), found(F.col("hollow"), name(F.col("hollow")), F.lit("empty_intermediate"), high))
        .when(framed, found(last, name(last), F.lit("format_failure"), F.lit("medium")))
        .otherwise(found(last, name(last), F.lit("final_step_fallback"), F.lit("low")))
    )
    return base.select("case_id", F.inline(rules))


def by_step(attributed: DataFrame) -> DataFrame:
    """Per step: how many cases, and the heuristic and confidence of its first case."""
    return attributed.groupBy("step").agg(
        F.count("*").alias("n"),
        F.min_by("heuristic", "case_id").alias("heuristic"),
        F.min_by("confidence", "case_id").alias("confidence"),
        F.min("case_id").alias("first_case"),
    )


def summary(attributed: DataFrame) -> DataFrame:
    """One row of totals by level; downstream steps of a cascade count for confidence only."""
    h = F.col("heuristic")
    counted, infrastructure = h != "cascade_downstream", h == "execution_failure"
    tool, structural = h.startswith(TOOL), h.isin(*STRUCTURAL)
    prompt = counted & ~infrastructure & ~tool & ~structural
    levels = [F.count_if(F.col("confidence") == c).alias(f"{c}_confidence") for c in ("high", "medium", "low")]
    tiers = [F.count_if(F.col("tier") == t).alias(f"{t}_tier") for t in ("partial", "miss")]
    return attributed.agg(
        F.count_if(counted).alias("total_failures"),
        F.count_if(prompt).alias("prompt_addressable"),
        F.count_if(prompt).alias("skill_addressable"),
        F.count_if(structural).alias("structural_addressable"),
        F.count_if(tool).alias("tool_addressable"),
        F.count_if(h == "format_failure").alias("format_failures"),
        F.count_if(infrastructure).alias("infrastructure_failures"),
        *levels,
        *tiers,
    )


def ordered_steps(rows: DataFrame, case: str, order: str, name: str, output: str) -> DataFrame:
    """Steps of each case as an ordered array."""
    step = F.struct(F.col(order).alias("o"), F.col(name).alias("name"), F.col(output).alias("output"))
    collected = rows.groupBy(case).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return collected.withColumn("steps", F.transform("steps", lambda s: F.struct(s["name"].alias("name"), s["output"].alias("output"))))


def first_failed_call(calls: DataFrame, case: str, order: str, tool: str, message: str) -> DataFrame:
    """First failed tool call of each case, and how many failed."""
    w = Window.partitionBy(case).orderBy(order)
    failed = calls.filter(F.col(message) != "").withColumn("n", F.row_number().over(w)).withColumn("failures", F.count("*").over(Window.partitionBy(case)))
    return failed.filter("n = 1").select(case, F.struct(F.col(tool).alias("tool"), F.col(message).alias("message")).alias("tool_error"), "failures")


def case_evidence(expected: Column) -> Column:
    """What a case says its answer should be: the first scalar among its known keys, else a scalar itself."""
    keys = ("answer", "expected_answer", "reference_output", "label", "cwe_id")
    whole = F.when(~F.schema_of_variant(expected).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(expected, "$", "string"))
    scalar = lambda k: F.when(~F.schema_of_variant(F.try_variant_get(expected, f"$.{k}", "variant")).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(expected, f"$.{k}", "string"))
    return F.coalesce(*map(scalar, keys), whole)


def verified(results: DataFrame, cases: DataFrame, issues: DataFrame, threshold: float = 100.0) -> DataFrame:
    """``attribute`` over results of runs without an issue (run_id, code), joined with their own cases: the evidence of a case is used only
    where its run was found sound. ``results`` has run_id, case_id and the columns of ``attribute`` but question and expected,
    which come from ``cases`` (run_id, case_id, question, expected as JSON text)."""
    sound = results.join(issues.select("run_id").distinct(), "run_id", "left_anti")
    told = cases.select("run_id", "case_id", "question", case_evidence(F.try_parse_json("expected")).alias("expected"))
    joined = sound.join(told, ["run_id", "case_id"]).withColumn("case_id", F.struct("run_id", "case_id"))
    return attribute(joined, threshold).select("case_id.*", "pos", "step", "heuristic", "confidence", "tier")
