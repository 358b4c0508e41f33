"""Group coverage of the manual sample goes through all groups that are left."""

import hashlib
import random

import pytest

from evalloom.operators import sampling

SCHEMA = "record_id string, group_id string, task_id string, trial int, event_count int, tool_error_count int, categories array<string>"


def digest(*parts):
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def stepwise(rows, categories, count, seed, target=20):
    """The choice, one pick after another over all rows."""
    chosen = []

    def pick(holds, stratum, diverse=True, first=lambda r: ()):
        if len(chosen) >= count:
            return False
        trials = [c[3] for c, _ in chosen]
        free = [r for r in rows if holds(r) and not any(r[c] is not None and r[c] in {x[c] for x, _ in chosen} for c in ((0, 1, 2) if diverse else (0,)))]
        if free:
            chosen.append((min(free, key=lambda r: (first(r), trials.count(r[3]), abs(r[4] - target), digest(seed, stratum, r[0]))), stratum))
        return bool(free)

    for c in sorted(categories):
        pick(lambda r, c=c: c in r[6], f"operation:{c}")
    pick(lambda r: not r[6], "operation:no_consequential_action")
    pick(lambda r: r[5] > 0, "shape:tool_error")
    pick(lambda r: len(r[6]) >= 2, "shape:multi_action")
    while pick(lambda r: r[1] is not None, "group_coverage", first=lambda r: (digest(seed, "group", r[1]), r[1])):
        pass
    while len(chosen) < count:
        pick(lambda r: True, "fill", diverse=False)
    return sorted((r[0], s) for r, s in chosen)


@pytest.mark.parametrize(("seed", "count", "head"), [("a", 12, 64), ("b", 60, 64), ("c", 40, 2)])
def test_the_choice_equals_one_pick_after_another(spark, monkeypatch, seed, count, head):
    """With short heads the lists run dry and are filled again."""
    rng = random.Random(seed)
    rows = [
        (f"r{i}", rng.choice([None, *[f"g{j}" for j in range(25)]]), rng.choice([None, *[f"t{j}" for j in range(30)]]), rng.randrange(3), rng.randrange(60), rng.randrange(2), sorted(rng.sample(["refund", "cancel", "pay"], rng.randrange(3))))
        for i in range(150)
    ]
    monkeypatch.setattr(sampling, "HEAD", head)
    monkeypatch.setattr(sampling, "GROUP_HEAD", head)
    got = sampling.select_records(spark.createDataFrame(rows, SCHEMA), ["refund", "cancel"], count, seed).collect()
    assert sorted((r["record_id"], r["stratum"]) for r in got) == stepwise(rows, ["refund", "cancel"], count, seed)


def test_a_large_sample_needs_no_more_jobs(spark):
    rows = spark.createDataFrame([(f"r{i}", f"g{i}", f"t{i}", i % 3, i % 40, 0, []) for i in range(600)], SCHEMA)
    jobs = {}
    for count in (5, 200):
        group = f"sample-{count}"
        spark.sparkContext.setJobGroup(group, group)
        assert sampling.select_records(rows, [], count, "s").count() == count
        jobs[count] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[200] <= jobs[5] + 8


def test_groups_of_a_used_task_do_not_use_up_the_coverage(spark):
    rows = [(f"a{i}", f"ga{i}", "t0", 0, 20, 0, ["refund"]) for i in range(60)]
    rows += [(f"b{i}", f"gb{i}", f"t{i + 1}", 0, 20, 0, ["refund"]) for i in range(5)]
    schema = "record_id string, group_id string, task_id string, trial int, event_count int, tool_error_count int, categories array<string>"
    got = sampling.select_records(spark.createDataFrame(rows, schema), [], 6, "s").collect()
    # Six tasks, so six records by group, one of them of the task with sixty groups.
    assert [r["stratum"] for r in got] == ["group_coverage"] * 6
    assert sum(r["record_id"].startswith("a") for r in got) == 1
