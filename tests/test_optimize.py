"""The search's state machine: stop rules, decisions, ledger, and resumption after any event."""

import shutil

import pytest

from evalloom.operators.optimize import EVALUATION, PLAN, Policy, run_optimization

TRAIN, VAL = [f"t{i}" for i in range(12)], [f"v{i}" for i in range(12)]


def recorded(spark, scores, plans, repeats=1):
    """``scores``: candidate -> (score of each train case, of each val case); a number counts for all, a dict by place."""
    rows = []
    for candidate, splits in scores.items():
        for split, cases, value in zip(("train", "val", "test"), (TRAIN, VAL, VAL), splits, strict=False):
            for i, case in enumerate(cases):
                v = value.get(i, value["rest"]) if isinstance(value, dict) else value
                for r in range(repeats):
                    rows.append((candidate, split, r, case, "failed" if v is None else "succeeded", v))
    return spark.createDataFrame(plans, PLAN), spark.createDataFrame(rows, EVALUATION)


def plan(iteration, place, candidate, config, level="prompt", reason=None):
    return (iteration, place, candidate, level, f"tech-{candidate}", config, reason)


BASE = {"p": "0", "q": "0"}
SCORES = {
    "c000": (50.0, 50.0, 40.0), "c001a": (60.0, 55.0), "c001b": (70.0, 60.0), "c002a": (40.0, 90.0), "c003a": ({0: 100.0, "rest": 71.0}, 58.0),
    "c004a": (80.0, {0: 100.0, "rest": 56.0}), "c005m": (85.0, 75.0, 70.0), "c001b-final": (0.0, 65.0), "c000-final": (0.0, 60.0), "c005m-final": (0.0, 64.0), "c004a-final": (0.0, 20.0),
}
PLANS = [
    plan(1, 0, "c001a", {"p": "1", "q": "0"}), plan(1, 1, "c001b", {"p": "2", "q": "0"}), plan(1, 2, "c001c", {"p": "2", "q": "0"}), plan(1, 3, "c001d", None),
    plan(2, 0, "c002a", {"p": "3", "q": "0"}), plan(3, 0, "c003a", {"p": "4", "q": "0"}, "parameter"), plan(4, 0, "c004a", {"p": "5", "q": "0"}, "parameter"),
]


def run(spark, path, scores, plans, policy, **more):
    given = recorded(spark, scores, plans)
    return run_optimization(spark, policy, str(path), BASE, *given, **more).orderBy("seq").collect()


def test_a_search_and_its_resumption_after_any_event(spark, tmp_path):
    policy = Policy(("prompt", "parameter"), 6, plateau_patience=2, resamples=50, finalists=2, pareto_parent=False)
    whole = run(spark, tmp_path / "whole", SCORES, PLANS, policy)
    rounds = [(e["iteration"], e["candidate_id"], e["parent_id"], e["reason"]) for e in whole if e["type"] == "iteration"]
    # Round 5 and 6 have no recorded reply.
    assert rounds == [
        (1, "c001b", "c000", "accepted"), (2, "c002a", "c001b", "train_screen"), (3, "c003a", "c001b", "selection_below_threshold"), (4, "c004a", "c001b", "selection_below_threshold"),
        (5, None, "c001b", "role_error"), (6, None, "c001b", "role_error"),
    ]
    first = whole[1]
    assert {x["candidate_id"]: x["reason"] for x in first["alternatives"]} == {"c001a": "not_selected", "c001c": "duplicate_config", "c001d": "review_failed"}
    assert (first["train_delta"], first["val_delta"], first["p_improve"]) == (20.0, 10.0, 1.0)
    assert (whole[-1]["type"], whole[-1]["stop_reason"], whole[-1]["chosen_id"]) == ("final", "max_iterations", "c001b")
    for cut in (1, 3, len(whole) - 1):
        path = tmp_path / f"cut{cut}"
        assert len(run(spark, path, SCORES, PLANS, policy, most_events=cut)) == cut
        assert run(spark, path, SCORES, PLANS, policy, resume=True) == whole
    # A write that broke off leaves no mark and is made again.
    torn = tmp_path / "cut1" / f"event-{len(whole) - 1:06d}"
    (torn / "_SUCCESS").unlink()
    assert run(spark, tmp_path / "cut1", SCORES, PLANS, policy, resume=True) == whole
    with pytest.raises(ValueError, match="already exists"):
        run(spark, tmp_path / "whole", SCORES, PLANS, policy)
    shutil.rmtree(tmp_path / "whole" / "event-000001")
    with pytest.raises(ValueError, match="events are missing"):
        run(spark, tmp_path / "whole", SCORES, PLANS, policy, resume=True)


def stopped(spark, path, scores, plans, policy):
    events = run(spark, path, scores, plans, policy)
    return events[-1]["stop_reason"], len([e for e in events if e["type"] == "iteration"])


def test_stop_rules(spark, tmp_path):
    quick = {"resamples": 20, "pareto_parent": False}
    assert stopped(spark, tmp_path / "target", SCORES, PLANS, Policy(("prompt",), 5, target_score=60.0, **quick)) == ("target_reached", 1)
    misses = [plan(i, 0, f"m{i}", {"p": str(i + 9)}, "prompt" if i < 3 else "parameter") for i in range(1, 7)]
    poor = {"c000": (50.0, 50.0)} | {f"m{i}": (10.0, 10.0) for i in range(1, 7)}
    # Each level has its own patience: two rounds of either.
    assert stopped(spark, tmp_path / "levels", poor, misses, Policy(("prompt", "parameter"), 9, plateau_patience=2, **quick)) == ("levels_exhausted", 4)
    assert stopped(spark, tmp_path / "sound", {"c000": (100.0, 50.0)}, [], Policy(("prompt",), 9, **quick)) == ("no_train_failures", 0)
    assert stopped(spark, tmp_path / "budget", poor, misses, Policy(("prompt", "parameter"), 1, **quick)) == ("max_iterations", 1)


def test_decisions_by_tiebreak_without_validation_and_with_failed_cases(spark, tmp_path):
    quick = {"resamples": 50, "pareto_parent": False}
    scores = {"c000": (50.0, 50.0), "x": (60.0, 50.0)}
    plans = [plan(1, 0, "x", {"p": "7"})]
    assert run(spark, tmp_path / "tie", scores, plans, Policy(("prompt",), 1, train_tiebreak=True, **quick))[1]["reason"] == "accepted_train_tiebreak"
    assert run(spark, tmp_path / "no", scores, plans, Policy(("prompt",), 1, **quick))[1]["reason"] == "selection_below_threshold"
    only = run(spark, tmp_path / "train", scores, plans, Policy(("prompt",), 1, has_val=False, **quick))
    assert (only[1]["reason"], only[1]["selection_score"], only[1]["val_delta"]) == ("accepted", 60.0, None)
    failed = run(spark, tmp_path / "failed", scores | {"x": ({0: None, "rest": 60.0}, 90.0)}, plans, Policy(("prompt",), 1, **quick))
    assert failed[1]["train_score"] == 55.0
    with pytest.raises(ValueError, match="no val evaluation of x"):
        run(spark, tmp_path / "lost", {"c000": (50.0, 50.0), "x": (60.0,)}, plans, Policy(("prompt",), 1, **quick))


def test_merge_final_selection_and_test(spark, tmp_path):
    """Two members that changed different settings are merged; the fresh scores choose; the test runs once."""
    plans = [plan(1, 0, "c001b", {"p": "2", "q": "0"}), plan(2, 0, "c002x", {"p": "0", "q": "3"}), plan(3, 0, "c003x", {"p": "9", "q": "9"})]
    scores = {
        "c000": ({0: 0.0, "rest": 55.0}, 50.0, 40.0), "c001b": ({0: 100.0, "rest": 50.0}, 60.0, 1.0), "c002x": ({1: 100.0, "rest": 52.0}, 61.0, 45.0), "c003x": (10.0, 10.0), "c003m": (85.0, 75.0, 70.0),
        "c003m-final": (0.0, 64.0), "c002x-final": (0.0, 66.0), "c002m": (1.0, 1.0),
    }
    policy = Policy(("prompt",), 3, resamples=50, finalists=2, merge=True)
    # The baseline is best on all training cases but one, so the second round is drawn to branch from it.
    path = tmp_path / "ledger"
    events = run(spark, path, scores, plans, policy, most_events=2)
    assert events[1]["accepted"]
    got = run(spark, path, scores, plans, policy, resume=True, final_test=True)
    kinds = [e["type"] for e in got]
    assert kinds[0] == "baseline" and kinds[-2:] == ["test_started", "final"] and kinds.count("iteration") == 3
    assert [(e["candidate_id"], e["parent_id"], e["accepted"]) for e in got[1:4]] == [("c001b", "c000", True), ("c002x", "c000", True), ("c003m", "c002x", True)]
    assert (got[3]["level"], got[3]["merge_of"], got[3]["config"]) == ("merge", ["c001b", "c002x"], {"p": "2", "q": "3"})
    assert [(f["candidate_id"], f["fresh_score"]) for f in got[4]["finalists"]] == [("c003m", 64.0), ("c002x", 66.0)]
    assert got[-1]["chosen_id"] == "c002x" and got[-1]["test_scores"] == {"c000": 40.0, "c002x": 45.0}
    with pytest.raises(ValueError, match="already evaluated"):
        run(spark, path, scores, plans, policy, resume=True)
