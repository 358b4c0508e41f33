"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of severities and of a trajectory's four parts.
SEVERITY = {"critical": 3.0, "major": 2.0, "minor": 1.0}
STATUS = {"satisfied": 1.0, "partial": 0.5, "violated": 0.0}
SELECTION, ORDERING, ARGUMENTS, REDUNDANCY = 0.35, 0.20, 0.30, 0.15


def exact_match(a: Column, b: Column) -> Column:
    return F.when(a == b, 100.0).otherwise(0.0)


def token_f1(predicted: Column, expected: Column) -> Column:
    """Overlap F1 of two token arrays as multisets, times 100; 0 if either is empty. For answers: work grows with
    the product of the lengths; ``operators.evidence.token_f1`` compares long texts."""
    common = F.aggregate(
        F.array_distinct(predicted),
        F.lit(0),
        lambda n, t: n + F.least(F.size(F.filter(predicted, lambda x: x == t)), F.size(F.filter(expected, lambda x: x == t))),
    )
    total = F.size(predicted) + F.size(expected)
    return F.when(total > 0, 200.0 * common / total).otherwise(0.0)


def severity_weight(severity: Column) -> Column:
    """Weight of a severity: major where it is missing, 1 where it is unknown."""
    out = F.when(severity.isNull(), SEVERITY["major"])
    for name, weight in SEVERITY.items():
        out = out.when(severity == name, weight)
    return out.otherwise(1.0)


def status_value(status: Column) -> Column:
    """Credit of a verdict: a missing or unknown one counts as violated, not_applicable as null."""
    out = F.when(status == "not_applicable", F.lit(None).cast("double"))
    for name, value in STATUS.items():
        out = out.when(status == name, value)
    return out.otherwise(STATUS["violated"])


def tool_selection(actual: Column, expected: Column) -> Column:
    """Called against expected tools, both as distinct arrays."""
    both = F.size(F.array_intersect(actual, expected))
    n = F.size(expected)
    return (
        F.when(n == 0, F.when(F.size(actual) == 0, 100.0).otherwise(30.0))
        .when(both == n, 100.0)
        .otherwise(both / n * 70.0)
    )


def call_ordering(actual: Column, expected: Column) -> Column:
    """How far the expected sequence runs through the actual one, times 100; fewer than two steps are in order."""
    reached = F.aggregate(
        actual, F.lit(0), lambda i, t: F.when((i < F.size(expected)) & (F.get(expected, i) == t), i + 1).otherwise(i)
    )
    return F.when(F.size(expected) < 2, 100.0).otherwise(reached / F.size(expected) * 100.0)


def non_redundancy(failed: Column, duplicates: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - 20.0 * failed - 15.0 * duplicates)


def called_with(calls: Column, tool: Column, arguments: Column) -> Column:
    """Whether some call (struct tool, arguments as a map of texts) of this tool has every expected argument; more arguments
    do not matter, and values are compared as texts."""
    return F.exists(
        calls, lambda c: (c["tool"] == tool) & F.forall(F.map_entries(arguments), lambda e: F.coalesce(F.try_element_at(c["arguments"], e["key"]) == e["value"], F.lit(False)))
    )


def argument_match(calls: Column, expected: Column) -> Column:
    """Share of the expected steps with arguments that some successful call matches, times 100; without such steps 100."""
    told = F.filter(expected, lambda s: s["arguments"].isNotNull())
    hit = F.filter(told, lambda s: called_with(calls, s["tool"], s["arguments"]))
    return F.when(F.coalesce(F.size(told), F.lit(0)) <= 0, 100.0).otherwise(100.0 * F.size(hit) / F.size(told))


def repeated_calls(calls: Column) -> Column:
    """How many calls repeat an earlier one: the same tool with equal arguments, whatever their order."""
    seen = F.transform(calls, lambda c: F.concat_ws("\x1f", c["tool"], F.to_json(F.array_sort(F.map_entries(c["arguments"])))))
    return F.size(seen) - F.size(F.array_distinct(seen))


def judged(judge: Column, path: Column, judge_weight: float, path_weight: float) -> Column:
    """Weighted mean of a judge's score and a trajectory's, weights brought to a sum of 1; a missing score leaves the other."""
    total = judge_weight + path_weight
    both = (judge_weight * judge + path_weight * path) / F.lit(total)
    return F.coalesce(both, judge, path)


def final_output(output: Column, steps: Column) -> Column:
    """The text that is scored: the output, else that of the last step."""
    return F.coalesce(output, F.try_element_at(steps, F.lit(-1))["output"], F.lit(""))


def identifier_score(text: Column, expected: Column) -> tuple[Column, Column]:
    """(exact, format) of a reply that should be one weakness id: 100 for the expected one; the format is proper (100) for the id
    alone, improper (50) where it stands among other text, and else invalid (0)."""
    ids = F.regexp_extract_all(F.upper(text), F.lit(r"\bCWE-(\d+)\b"), 1)
    found = F.try_element_at(ids, F.lit(-1))
    form = F.when(F.upper(F.trim(text)).rlike(r"^CWE-\d+$"), 100.0).when(F.size(ids) > 0, 50.0).otherwise(0.0)
    return F.when(found == F.regexp_extract(F.upper(expected), r"(\d+)", 1), 100.0).otherwise(0.0), form


def trajectory(selection: Column, ordering: Column, arguments: Column, redundancy: Column) -> Column:
    return SELECTION * selection + ORDERING * ordering + ARGUMENTS * arguments + REDUNDANCY * redundancy


def retrieval_overlap(query: Column, output: Column) -> Column:
    """Share of the query's distinct tokens in the output: 0 for a blank output, 1 without a query."""

    def tokens(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda t: t != ""))

    q = tokens(F.coalesce(query, F.lit("")))
    return (
        F.when(output.isNull() | (F.trim(output) == ""), 0.0)
        .when(F.size(q) == 0, 1.0)
        .otherwise(F.size(F.array_intersect(q, tokens(output))) / F.size(q))
    )


def retrieval_tier(overlap: Column) -> Column:
    return F.when(overlap >= 0.4, "hit").when(overlap >= 0.2, "partial").otherwise("miss")


def run_status(total: Column, succeeded: Column) -> Column:
    return F.when(succeeded == total, "completed").when(succeeded > 0, "degraded").otherwise("failed")
