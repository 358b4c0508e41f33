"""Reports as Markdown rows: (section, line, text), so that any writer can put them out in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_lines(df: DataFrame, section: int, title: str, order: list[Column]) -> DataFrame:
    """A small table as Markdown lines, rows in ``order``; for aggregates, whose rows fit one task."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("text"), (F.row_number().over(Window.orderBy(*order)) + 3).alias("line"))
    head = [(1, f"## {title}"), (2, "| " + " | ".join(df.columns) + " |"), (3, "|" + "---|" * len(df.columns))]
    top = df.sparkSession.createDataFrame([(t, i) for i, t in head], "text string, line int")
    return top.unionByName(body).select(F.lit(section).alias("section"), "line", "text")


def names(values: Column, most: int = 20) -> Column:
    """The first names of a list, and how many more there are."""
    more = F.size(values) - most
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" and "), more, F.lit(" more"))).otherwise(""))


def dialogue_text(record: Column, order: Column, messages: Column) -> Column:
    """A dialogue for reviewers: a heading, then each message under its role."""
    said = F.transform(F.filter(messages, lambda m: m["role"].isin("user", "assistant")), lambda m: F.concat(F.lit("**"), F.initcap(m["role"]), F.lit("**\n\n"), m["content"]))
    return F.concat(F.lit("# "), order.cast("string"), F.lit(". "), record, F.lit("\n\n"), F.array_join(said, "\n\n"))


def labelled_field(text: Column, prefix: str) -> Column:
    """Value of the one line that starts with ``prefix``; null if there is none or more than one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith(prefix))
    return F.when(F.size(lines) == 1, F.trim(F.substring(F.get(lines, F.lit(0)), len(prefix) + 1, 1 << 20)))


def summary_lines(results: DataFrame, attributed: DataFrame | None = None) -> DataFrame:
    """(section, line, text): an evaluation's summary. ``results`` has case_id, ok, score, breakdown (map), timings (array of
    structs name and seconds), tier and, if rows have an order of their own, pos; ``attributed`` has step and heuristic. Steps come as they
    are first seen. Sections hold aggregates only; an empty one is
    left out."""
    good = results.filter("ok")
    counts = results.agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.avg(F.when(F.col("ok"), F.col("score"))).alias("mean"))
    head = F.array(
        F.lit("# Evaluation Summary"), F.lit(""), F.concat(F.lit("Total cases: "), F.col("n").cast("string")), F.concat(F.lit("Successful cases: "), F.col("ok").cast("string")),
        F.concat(F.lit("Infrastructure failures: "), (F.col("n") - F.col("ok")).cast("string")), F.lit(""),
    )
    mean = F.when(F.col("mean").isNotNull(), F.array(F.lit("## Composite Score"), F.concat(F.lit("- average: "), F.format_string("%.2f", "mean")), F.lit("")))
    top = counts.select(F.lit(0).alias("section"), F.posexplode(F.concat(head, F.coalesce(mean, F.array().cast("array<string>")))).alias("line", "text"))
    parts = good.select(F.explode("breakdown").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).crossJoin(F.broadcast(counts.select("ok")))  # counts: one row
    shown = parts.select(F.col("k").alias("key"), F.concat(F.lit("- "), "k", F.lit(": "), F.format_string("%.2f", F.col("v") / F.col("ok"))).alias("text"))
    points = parts.groupBy().agg(F.max(F.when(F.col("k") == "points_earned", F.col("v"))).alias("e"), F.max(F.when(F.col("k") == "points_possible", F.col("v"))).alias("p")).filter("e is not null and p is not null")
    share = F.when(F.col("p") > 0, 100 * F.col("e") / F.col("p")).otherwise(0.0)
    weighted = points.select(
        F.lit(2).alias("section"),
        F.posexplode(
            F.array(
                F.lit(""), F.lit("## Weighted Score"), F.concat(F.lit("- weighted_score: "), F.format_string("%.2f", share)),
                F.concat(F.lit("- total_earned: "), F.format_string("%.0f", "e")), F.concat(F.lit("- total_possible: "), F.format_string("%.0f", "p")),
            )
        ).alias("line", "text"),
    )
    place = F.col("pos" if "pos" in results.columns else "case_id").alias("place")
    visits = good.select("case_id", place, F.posexplode("timings").alias("i", "t")).select("case_id", "t.name", "t.seconds", F.struct("place", "i").alias("seen"))
    steps = visits.groupBy("name").agg(*_spread("seconds"), F.min("seen").alias("seen"))
    whole = visits.groupBy("case_id").agg(F.sum("seconds").alias("seconds")).agg(*_spread("seconds")).filter("n > 0").withColumn("name", F.lit("Total"))

    def row(mark: str) -> Column:
        cell = lambda c: F.concat(F.lit(mark), c, F.lit(mark))
        return F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("name")), *[cell(F.format_string("%.3f", c)) for c in ("mean", "p50", "p95")]), F.lit(" |")).alias("text")

    tiers = results.filter("tier is not null").groupBy("tier").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.avg(F.when(F.col("ok"), F.col("score"))).alias("mean"))
    tier_cells = F.concat(F.lit("| "), F.concat_ws(" | ", "tier", "n", "ok", F.col("n") - F.col("ok"), F.coalesce(F.format_string("%.2f", "mean"), F.lit("N/A"))), F.lit(" |"))
    out = top.unionByName(_under(shown, 1, ["## Score Breakdown"], F.col("key"))).unionByName(weighted)
    heads = ["", "## Step Timings", "", "| Step | Avg (s) | P50 (s) | P95 (s) |", "|------|---------|---------|---------|"]
    last = whole.select(F.lit(True).alias("last"), F.lit(None).cast(steps.schema["seen"].dataType).alias("seen"), row("**"))
    out = out.unionByName(_under(steps.select(F.lit(False).alias("last"), "seen", row("")).unionByName(last), 3, heads, F.struct("last", "seen")))
    heads = ["", "## Trust-Tier Diagnostics", "", "| Trust tier | Total | Successful | Failed | Mean composite score |", "|---|---:|---:|---:|---:|"]
    out = out.unionByName(_under(tiers.select("tier", tier_cells.alias("text")), 4, heads, F.col("tier")))
    if attributed is None:
        return out
    found = attributed.filter("heuristic <> 'execution_failure'").groupBy("step").agg(F.count("*").alias("n"))
    broken = attributed.filter("heuristic = 'execution_failure'").agg(F.count("*").alias("n")).filter("n > 0")
    lost = broken.select(F.lit("0").alias("key"), F.concat(F.lit("- failed cases: "), F.col("n").cast("string")).alias("text"))
    out = out.unionByName(_under(lost, 5, ["", "## Infrastructure Failures", ""], F.col("key")))
    table = found.select("n", "step", F.concat(F.lit("| "), "step", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("text"))
    return out.unionByName(_under(table, 6, ["", "## Step Attribution", "", "| Step | Failure Count |", "|------|--------------|"], F.struct(-F.col("n"), "step")))


def _spread(c: str) -> list[Column]:
    return [
        F.count("*").alias("n"), F.avg(c).alias("mean"), F.expr(f"percentile({c}, 0.5)").alias("p50"),
        F.expr(f"percentile_disc(0.95) within group (order by {c})").alias("p95"),
    ]


def _under(rows: DataFrame, section: int, head: list[str], order: Column) -> DataFrame:
    """Lines (``text``) of a section's few aggregate rows in order, under a head that stands only where there are any."""
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "text"))).alias("l")).filter("size(l) > 0")
    lines = F.concat(F.array(*map(F.lit, head)), F.transform("l", lambda x: x["text"]))
    return listed.select(F.lit(section).alias("section"), F.posexplode(lines).alias("line", "text"))


def comparison_lines(comparison: DataFrame, extremes: DataFrame, checks: DataFrame, timings: DataFrame | None = None, issues: DataFrame | None = None) -> DataFrame:
    """(section, line, text): how a candidate run compares: the one row of ``runs.comparison``, the largest changes (kind, case_id,
    delta), the deltas of checks and of step timings (a name, baseline, candidate, delta), and what makes the runs incompatible
    (code, message); a comparison with such issues is marked as exploratory."""
    head = F.array(
        F.lit("## Composite Score"), F.concat(F.lit("- Baseline mean: "), F.format_string("%.2f", "baseline_mean")),
        F.concat(F.lit("- Candidate mean: "), F.format_string("%.2f", "candidate_mean")), F.concat(F.lit("- Mean delta: "), F.format_string("%+.2f", "mean_delta")),
        F.concat(F.lit("- Median delta: "), F.format_string("%+.2f", F.col("candidate_median") - F.col("baseline_median"))), F.lit(""),
    )
    title = comparison.select(F.lit(0).alias("section"), F.posexplode(F.array(F.lit("# Run Comparison"), F.lit(""))).alias("line", "text"))
    out = title.unionByName(comparison.select(F.lit(2).alias("section"), F.posexplode(head).alias("line", "text")))
    if issues is not None:
        warning = "> **EXPLORATORY / UNCONTROLLED:** this comparison does not support causal or headline claims."
        told = issues.select("code", F.concat(F.lit("- `"), "code", F.lit("`: "), "message").alias("text"))
        out = out.unionByName(_under(told, 1, [warning, "", "## Incompatibilities", ""], F.col("code")))
    for section, rows, name, digits, heads in (
        (3, checks, "check_name", 2, ["## Per-Check Deltas", "", "| Check | Baseline | Candidate | Delta |", "|-------|----------|-----------|-------|"]),
        (4, timings, "step", 3, ["## Per-Step Timing Deltas", "", "| Step | Baseline (s) | Candidate (s) | Delta (s) |", "|------|-------------|---------------|-----------|"]),
    ):
        if rows is not None:
            two = [F.format_string(f"%.{digits}f", c) for c in ("baseline", "candidate")]
            cells = F.concat(F.lit("| "), F.concat_ws(" | ", name, *two, F.format_string(f"%+.{digits}f", "delta")), F.lit(" |")).alias("text")
            out = out.unionByName(_under(rows.select(name, cells), section, heads, F.col(name)))
    changed = extremes.select("kind", "delta", "case_id", F.concat(F.lit("- "), F.col("case_id").cast("string"), F.lit(": "), F.format_string("%+.2f", "delta")).alias("text"))
    out = out.unionByName(_under(changed.filter("kind = 'regression'"), 5, ["## Largest Regressions", ""], F.struct("delta", "case_id")))
    return out.unionByName(_under(changed.filter("kind = 'improvement'"), 6, ["## Largest Improvements", ""], F.struct(-F.col("delta"), "case_id")))
