"""A diverse sample of records for manual feedback, blind to outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import stable_hash
from evalloom.session import checkpoint


#: Rows kept of each stratum and trial, and of each trial of a group, until they run dry.
HEAD = 64
GROUP_HEAD = 8
FIELDS = ("record_id", "group_id", "task_id", "trial", "distance", "key")


class _Heads:
    """The first rows of each (name, trial) by distance, then key; of rows alike in group and task the first only, since what
    excludes it excludes them. Where a list runs dry that was cut off, one query brings its next eligible row."""

    def __init__(self, rows: DataFrame, most: int, alike: bool = True):
        self.rows, self.most = rows, most
        order = [F.col("distance"), F.col("key")]
        firsts = rows
        if alike:
            own = lambda c: F.coalesce(F.concat(F.lit("="), c), F.concat(F.lit("~"), "record_id"))  # noqa: E731 - a missing one equals no other
            w = Window.partitionBy("name", "trial", own(F.col("group_id")), own(F.col("task_id"))).orderBy(*order)
            firsts = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
        top = firsts.withColumn("_n", F.row_number().over(Window.partitionBy("name", "trial").orderBy(*order))).filter(F.col("_n") <= most)
        self.lists: dict[str, dict[int, list]] = {}
        for r in top.orderBy("name", "trial", "_n").collect():
            self.lists.setdefault(r["name"], {}).setdefault(r["trial"], []).append(r)
        self.cut = {(n, t) for n, trials in self.lists.items() for t, found in trials.items() if len(found) == most}

    def eligible(self, name: str, chosen: _Chosen, diverse: bool) -> list:
        """The first eligible row of each trial."""
        out = []
        for trial, found in self.lists.get(name, {}).items():
            row = next((r for r in found if chosen.allows(r, diverse)), None)
            if row is None and (name, trial) in self.cut:
                row = self._next(name, trial, chosen, diverse)
                found[:] = [row] if row else []
                if row is None:
                    self.cut.discard((name, trial))
            if row is not None:
                out.append(row)
        return out

    def _next(self, name: str, trial: int, chosen: _Chosen, diverse: bool):
        left = self.rows.filter((F.col("name") == name) & F.col("trial").eqNullSafe(F.lit(trial)))
        for c in ("record_id", "group_id", "task_id") if diverse else ("record_id",):
            used = [r[c] for r in chosen.rows if r[c] is not None]
            left = left.filter(F.col(c).isNull() | ~F.col(c).isin(used)) if used else left
        return left.orderBy("distance", "key").first()


class _Chosen:
    """What has been chosen, and what that excludes."""

    def __init__(self):
        self.rows: list[dict] = []
        self.used: dict[str, set] = {"record_id": set(), "group_id": set(), "task_id": set()}
        self.trials: dict[int, int] = {}

    def allows(self, row, diverse: bool) -> bool:
        return not any(row[c] is not None and row[c] in self.used[c] for c in (self.used if diverse else ("record_id",)))

    def take(self, rows: list, stratum: str) -> bool:
        """The best of some rows: of the rarest trial, then the nearest, then by hash."""
        if not rows:
            return False
        best = min(rows, key=lambda r: (self.trials.get(r["trial"], 0), r["distance"], r["key"]))
        self.rows.append({**best.asDict(), "stratum": stratum})
        for c, seen in self.used.items():
            seen.add(best[c])
        self.trials[best["trial"]] = self.trials.get(best["trial"], 0) + 1
        return True


def select_records(metrics: DataFrame, categories: list[str], count: int, seed: str, target_events: int = 20) -> DataFrame:
    """(record_id, stratum, place): ``count`` records, one for each category, then one without a category, one with a tool
    error and one with several categories, then one for each group in a hashed order, then any.

    ``metrics`` has record_id, group_id, task_id, trial, event_count, tool_error_count and categories. Until
    the last step records, groups and tasks are taken once; the rarest trial goes first, then the length next to
    ``target_events``, then a hash. A record without a group or a task shares none with others. Trials are repetitions: a handful.

    Three queries bring the first rows of all strata, of the first groups, and of the rest; the choice among these is a lazy greedy
    walk. Further queries are made only where a list runs dry.
    """
    rows = checkpoint(metrics.withColumn("distance", F.abs(F.col("event_count") - target_events)))
    if not 1 <= count < rows.count():
        raise ValueError("count must leave at least one record")
    chosen = _Chosen()

    def named(name: Column, of: DataFrame) -> DataFrame:
        return of.withColumn("name", name).filter("name is not null").withColumn("key", stable_hash(F.lit(seed), F.col("name"), F.col("record_id"))).select("name", *FIELDS)

    strata = {f"operation:{c}": F.array_contains("categories", c) for c in sorted(categories)}
    strata |= {"operation:no_consequential_action": F.size("categories") == 0, "shape:tool_error": F.col("tool_error_count") > 0, "shape:multi_action": F.size("categories") >= 2}
    heads = _Heads(named(F.explode(F.array_compact(F.array(*[F.when(holds, F.lit(n)) for n, holds in strata.items()]))), rows), HEAD)
    for name in strata:
        if len(chosen.rows) < count:
            chosen.take(heads.eligible(name, chosen, diverse=True), name)
    place = stable_hash(F.lit(seed), F.lit("group"), F.col("group_id"))
    grouped = rows.filter("group_id is not null").withColumns({"name": F.col("group_id"), "group_place": place, "key": stable_hash(F.lit(seed), F.lit("group_coverage"), F.col("record_id"))})
    after, width = None, 2 * count + HEAD
    while len(chosen.rows) < count:
        # A group without an eligible record now has none later, so groups are walked once, so many at a time.
        left = grouped if after is None else grouped.filter(F.struct("group_place", "group_id") > F.struct(*map(F.lit, after)))
        order = [(r["group_place"], r["group_id"]) for r in left.select("group_place", "group_id").distinct().orderBy("group_place", "group_id").limit(width).collect()]
        if not order:
            break
        last = F.struct(*map(F.lit, order[-1]))
        heads = _Heads(left.filter(F.struct("group_place", "group_id") <= last).select("name", *FIELDS), GROUP_HEAD)
        for _, group in order:
            if len(chosen.rows) < count and group not in chosen.used["group_id"]:
                chosen.take(heads.eligible(group, chosen, diverse=True), "group_coverage")
        after = order[-1]
    if len(chosen.rows) < count:
        # At most ``count`` records are taken before, so twice as many of each trial hold all that can be chosen.
        heads = _Heads(named(F.lit("fill"), rows), 2 * count, alike=False)
        while len(chosen.rows) < count:
            chosen.take(heads.eligible("fill", chosen, diverse=False), "fill")
    out = rows.sparkSession.createDataFrame([(r["record_id"], r["stratum"]) for r in chosen.rows], "record_id string, stratum string")
    return out.withColumn("place", stable_hash(F.lit(seed), F.lit("annotation"), F.col("record_id"))).orderBy("place")


def record_metrics(records: DataFrame, categories: dict[str, str]) -> DataFrame:
    """What can be seen of records without their outcomes: counts of events, calls and failed calls, the categories of the tools called
    (``categories`` by tool), and task and trial from the runtime (JSON text)."""
    kinds = F.create_map(*[F.lit(x) for pair in sorted(categories.items()) for x in pair]) if categories else F.create_map().cast("map<string, string>")
    called = F.array_sort(F.array_distinct(F.array_compact(F.transform("tool_calls", lambda c: F.try_element_at(kinds, c["name"])))))
    failed = F.filter("tool_calls", lambda c: F.coalesce(c["error"], F.lit("")) != "")
    return records.select(
        "record_id", "group_id", F.get_json_object("runtime", "$.task_id").alias("task_id"), F.coalesce(F.get_json_object("runtime", "$.trial").try_cast("int"), F.lit(0)).alias("trial"),
        F.coalesce(F.size(F.coalesce("events", F.array().cast(records.schema["events"].dataType))), F.lit(0)).alias("event_count"), F.size("tool_calls").alias("tool_call_count"),
        F.size(failed).alias("tool_error_count"), called.alias("categories"),
    )
