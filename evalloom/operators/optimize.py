"""A candidate search as a resumable state machine over an append-only ledger.

Replies of the roles (plans) and evaluations are recorded tables; the machine decides what the search does with them. The
driver keeps the ledger's events, of which a search has some hundreds; everything over cases (scores of candidates, failing
cases, votes for a parent, paired tests) is a query. An event is written before the next decision is made and nothing else is
remembered, so a search that is cut after any event and started again goes on as if it had not been.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalloom.operators import loop, merges, search
from evalloom.operators.runs import PASS

ENTRY = (
    "candidate_id string, parent_id string, level string, technique string, merge_of array<string>, config map<string, string>, train_score double, "
    "train_delta double, selection_score double, val_delta double, p_improve double, accepted boolean, reason string"
)
EVENT = (
    f"seq int, type string, iteration int, {ENTRY}, alternatives array<struct<{ENTRY}>>, "
    "finalists array<struct<candidate_id: string, selection_score: double, fresh_score: double>>, chosen_id string, stop_reason string, test_scores map<string, double>"
)
#: Recorded replies: a plan for each row; an iteration whose role failed is one row without a candidate.
PLAN = "iteration int, place int, candidate_id string, level string, technique string, config map<string, string>, reason string"
#: Recorded evaluations, one row for each case and repeat; those of the final selection are of ``<candidate>-final``.
EVALUATION = "candidate_id string, split string, repeat int, case_id string, execution_status string, score double"
BASELINE = "c000"


@dataclass(frozen=True)
class Policy:
    """What a search may do and when it stops."""

    levels: tuple[str, ...]
    max_iterations: int
    plateau_patience: int = 3
    target_score: float | None = None
    min_train_delta: float = 0.0
    min_val_delta: float = 0.0
    confidence: float = 0.8
    train_tiebreak: bool = False
    has_val: bool = True
    finalists: int = 1
    pareto_parent: bool = True
    merge: bool = False
    resamples: int = 2000


class Ledger:
    """Events in order, each a directory of its own: complete once Spark has committed it, never changed afterwards."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = StructType.fromDDL(EVENT)
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/event-*/_SUCCESS")
        whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
        paths = sorted(str(f.getPath().getParent()) for f in whole or [])
        rows = spark.read.schema(self.schema).json(paths).orderBy("seq").collect() if paths else []
        self.events: list[dict] = [r.asDict(recursive=True) for r in rows]
        if [e["seq"] for e in self.events] != list(range(len(self.events))):
            raise ValueError(f"{path}: events are missing")

    def append(self, **event) -> dict:
        row = {name: None for name in self.schema.names} | event | {"seq": len(self.events)}
        # A torn write of the same event, which has no mark, is replaced; complete events never are.
        self.spark.createDataFrame([Row(**row)], self.schema).coalesce(1).write.mode("overwrite").json(f"{self.path}/event-{row['seq']:06d}")
        self.events.append(row)
        return row

    def of(self, kind: str) -> list[dict]:
        return [e for e in self.events if e["type"] == kind]

    def iterations(self) -> DataFrame:
        return self.spark.createDataFrame([Row(**e) for e in self.of("iteration")], self.schema)


class _Search:
    def __init__(self, ledger: Ledger, policy: Policy, plans: DataFrame, evaluations: DataFrame):
        self.ledger, self.policy, self.plans = ledger, policy, plans
        counted = F.when(F.col("execution_status") == "failed", 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
        self.results = evaluations.withColumn("counted", counted)
        self.spark = ledger.spark

    # State, from the ledger alone ---------------------------------------------------------------------

    def pool(self) -> list[dict]:
        return self.ledger.of("baseline") + [e for e in self.ledger.of("iteration") if e["accepted"]]

    def best(self, pool: list[dict]) -> dict:
        return max(enumerate(pool), key=lambda x: (x[1]["selection_score"], x[1]["train_score"], -x[0]))[1]

    def entries(self) -> list[dict]:
        return [x for e in self.ledger.of("iteration") for x in (e, *(e["alternatives"] or []))]

    def allowed(self) -> list[str]:
        misses = {r["level"]: r["misses"] for r in loop.misses(self.ledger.iterations()).collect()} if self.ledger.of("iteration") else {}
        return [level for level in self.policy.levels if misses.get(level, 0) < self.policy.plateau_patience]

    # Queries over cases -------------------------------------------------------------------------------

    def of(self, ids: list[str], split: str) -> DataFrame:
        return self.results.filter(F.col("candidate_id").isin(ids) & (F.col("split") == split))

    def means(self, ids: list[str], split: str) -> dict[str, float]:
        """Mean of each candidate over all its cases and repeats, failed ones as 0."""
        found = {r["candidate_id"]: r["m"] for r in self.of(ids, split).groupBy("candidate_id").agg(F.avg("counted").alias("m")).collect()}
        lost = [i for i in ids if i not in found]
        if lost:
            raise ValueError(f"no {split} evaluation of {lost[0]} is recorded")
        return found

    def fails(self, candidate: str) -> bool:
        failing = (F.col("execution_status") == "failed") | (F.col("counted") < PASS)
        return not self.of([candidate], "train").filter(failing).isEmpty()

    def improvement(self, candidate: str, reference: str, split: str) -> float:
        """Share of resamples in which the candidate beats its reference; a case counts by its mean over repeats."""
        case = self.of([candidate, reference], split).groupBy("case_id").agg(
            F.avg(F.when(F.col("candidate_id") == candidate, F.col("counted"))).alias("c"), F.avg(F.when(F.col("candidate_id") == reference, F.col("counted"))).alias("r")
        )
        gains = case.filter("c is not null and r is not null").select(F.lit(candidate).alias("candidate_id"), "case_id", (F.col("c") - F.col("r")).alias("gain"))
        row = search.bootstrap_gain(gains, "candidate_id", "case_id", "gain", self.policy.resamples).first()
        return row["p_improve"] if row else 0.0

    def parent(self, pool: list[dict], iteration: int) -> dict:
        if not self.policy.pareto_parent or len(pool) < 2:
            return self.best(pool)
        rows = [(m["candidate_id"], i, m["selection_score"], m["train_score"]) for i, m in enumerate(pool)]
        members = self.spark.createDataFrame(rows, "candidate_id string, pos int, selection_score double, train_score double")
        scores = self.of([m["candidate_id"] for m in pool], "train").groupBy("candidate_id", "case_id").agg(F.avg("counted").alias("score"))
        chosen = loop.parent(scores, members, iteration).first()["candidate_id"]
        return next(m for m in pool if m["candidate_id"] == chosen)

    # Steps --------------------------------------------------------------------------------------------

    def start(self, config: dict[str, str]) -> None:
        train = self.means([BASELINE], "train")[BASELINE]
        score = self.means([BASELINE], "val")[BASELINE] if self.policy.has_val else train
        self.ledger.append(type="baseline", candidate_id=BASELINE, config=config, train_score=train, selection_score=score)

    def stop_or_parent(self, iteration: int) -> tuple[str | None, dict | None, list[str]]:
        """Why the search ends before this iteration, or the parent and the levels of it."""
        pool = self.pool()
        best, allowed = self.best(pool), self.allowed()
        if iteration > self.policy.max_iterations:
            return "max_iterations", None, []
        if self.policy.target_score is not None and best["selection_score"] >= self.policy.target_score:
            return "target_reached", None, []
        if not allowed:
            return "levels_exhausted", None, []
        parent = self.parent(pool, iteration)
        if not self.fails(parent["candidate_id"]):
            if parent is best or not self.fails(best["candidate_id"]):
                return "no_train_failures", None, []
            parent = best
        return None, parent, allowed

    def merged(self, iteration: int, pool: list[dict], evaluated: list[dict]) -> dict | None:
        """The merge of two members of the pool, as an entry like a plan's."""
        if not self.policy.merge or len(pool) < 2:
            return None
        members = self.spark.createDataFrame([(m["candidate_id"], m["parent_id"], m["selection_score"]) for m in pool], "candidate_id string, parent_id string, selection_score double")
        settings = [(m["candidate_id"], k, v) for m in pool for k, v in (m["config"] or {}).items()]
        tried = [tuple(sorted(x["merge_of"])) for x in self.entries() if x["merge_of"]]
        found = merges.best_merge(
            members, self.spark.createDataFrame(settings, "candidate_id string, path string, value string"),
            self.spark.createDataFrame(tried, "a string, b string"), self.spark.createDataFrame([(c,) for c in evaluated], "config map<string, string>"),
        ).first()
        if found is None:
            return None
        two = [next(m for m in pool if m["candidate_id"] == found[x]) for x in ("a", "b")]
        reference = max(sorted(two, key=pool.index), key=lambda m: m["selection_score"])
        return {
            "candidate_id": f"c{iteration:03d}m", "parent": reference, "level": "merge", "technique": "merge", "merge_of": [found["a"], found["b"]], "config": dict(found["config"]), "reason": None
        }

    def iterate(self, iteration: int, parent: dict, allowed: list[str]) -> dict:
        """One round: plans, screen on train, decision on the best of those that pass. Appends and returns its event."""
        replies = [r.asDict() for r in self.plans.filter(F.col("iteration") == iteration).orderBy("place").collect()]
        broken = not replies or replies[0]["candidate_id"] is None or any(r["level"] not in allowed for r in replies)
        if broken:
            return self.ledger.append(type="iteration", iteration=iteration, parent_id=parent["candidate_id"], accepted=False, reason="role_error", alternatives=[])
        entries = [{**{k: r[k] for k in ("candidate_id", "level", "technique", "config", "reason")}, "parent": parent, "merge_of": None} for r in replies]
        for e in entries:
            if e["config"] is None and e["reason"] is None:
                e["reason"] = "review_failed"
        evaluated = [self.ledger.events[0]["config"]] + [x["config"] for x in self.entries() if x["config"]]
        merge = self.merged(iteration, self.pool(), evaluated)
        entries += [merge] if merge else []
        seen, fresh = list(evaluated), []
        for e in entries:
            if e["config"] is not None and e["reason"] is None:
                if e["config"] in seen:
                    e["reason"] = "duplicate_config"
                else:
                    seen.append(e["config"])
                    fresh.append(e)
        train = self.means([e["candidate_id"] for e in fresh], "train") if fresh else {}
        for e in fresh:
            e["train_score"] = train[e["candidate_id"]]
            e["train_delta"] = e["train_score"] - e["parent"]["train_score"]
            e["reason"] = "train_screen" if e["train_delta"] < self.policy.min_train_delta else "not_selected"
        passed = [e for e in fresh if e["reason"] == "not_selected"]
        if passed:
            chosen = max(passed, key=lambda e: e["train_score"])
            self.decide(chosen)
        else:
            chosen = max(fresh, key=lambda e: e["train_score"]) if fresh else entries[0]
        own = self._entry(chosen)
        rest = [self._entry(e) for e in entries if e is not chosen]
        return self.ledger.append(type="iteration", iteration=iteration, **own, alternatives=rest)

    @staticmethod
    def _entry(e: dict) -> dict:
        names = [c.split()[0] for c in ENTRY.replace("map<string, string>", "map").split(", ")]
        return {n: e.get(n) for n in names} | {"parent_id": e["parent"]["candidate_id"], "accepted": e.get("accepted", False)}

    def decide(self, e: dict) -> None:
        """The paired test of the chosen candidate against its reference, on validation or else on train."""
        p, candidate, reference = self.policy, e["candidate_id"], e["parent"]
        train_p = self.improvement(candidate, reference["candidate_id"], "train") if p.train_tiebreak or not p.has_val else 0.0
        if p.has_val:
            e["selection_score"] = self.means([candidate], "val")[candidate]
            e["val_delta"] = delta = e["selection_score"] - reference["selection_score"]
            sure = self.improvement(candidate, reference["candidate_id"], "val")
        else:
            e["selection_score"], delta, sure = e["train_score"], e["train_delta"], train_p
        e["p_improve"] = round(sure, 4)
        if delta > 0 and delta >= p.min_val_delta and sure >= p.confidence:
            e["reason"] = "accepted"
        elif p.train_tiebreak and p.has_val and delta >= 0 and e["train_delta"] > 0 and train_p >= p.confidence:
            e["reason"] = "accepted_train_tiebreak"
        else:
            e["reason"] = "selection_below_threshold"
        e["accepted"] = e["reason"] != "selection_below_threshold"

    def final(self) -> dict:
        """The member of the pool with the best fresh score among the first by rank; an earlier choice among the same is kept."""
        pool = self.pool()
        rank = lambda m: (m["selection_score"], m["train_score"], -pool.index(m))
        finalists = sorted(pool, key=rank, reverse=True)[: self.policy.finalists]
        if len(finalists) < 2:
            return finalists[0]
        ids = [m["candidate_id"] for m in finalists]
        before = self.ledger.of("final_selection")
        if before and [f["candidate_id"] for f in before[-1]["finalists"]] == ids:
            return next(m for m in pool if m["candidate_id"] == before[-1]["chosen_id"])
        fresh = self.means([f"{i}-final" for i in ids], "val" if self.policy.has_val else "train")
        chosen = max(finalists, key=lambda m: (fresh[f"{m['candidate_id']}-final"], *rank(m)))
        rows = [{"candidate_id": m["candidate_id"], "selection_score": m["selection_score"], "fresh_score": fresh[f"{m['candidate_id']}-final"]} for m in finalists]
        self.ledger.append(type="final_selection", finalists=rows, chosen_id=chosen["candidate_id"])
        return chosen


def run_optimization(
    spark: SparkSession, policy: Policy, path: str, config: dict[str, str], plans: DataFrame, evaluations: DataFrame, resume: bool = False, final_test: bool = False, most_events: int | None = None
) -> DataFrame:
    """The ledger (``EVENT``) of a search over recorded ``plans`` (``PLAN``) and ``evaluations`` (``EVALUATION``), from the baseline's ``config`` on.

    It ends when the target is reached, every level has used up its patience since the last acceptance, no training case of the
    parent and of the best fails, or the budget is spent. A ledger that exists is only continued with ``resume``, and never after a
    test. With ``most_events`` it stops after so many events, as if it had been interrupted. An evaluation that a decision needs and
    that is not recorded is an error. Levels that a plan must not use make the round a failed role.
    """
    ledger = Ledger(spark, path)
    if ledger.events and not resume:
        raise ValueError(f"{path} already exists; resume it or choose another path")
    if any(e["test_scores"] or e["type"] == "test_started" for e in ledger.events):
        raise ValueError("the test split was already evaluated; start a new search")
    run = _Search(ledger, policy, plans, evaluations)

    def halted() -> bool:
        return most_events is not None and len(ledger.events) >= most_events

    if not ledger.events:
        run.start(config)
    elif ledger.events[0]["type"] != "baseline":
        raise ValueError(f"{path} does not start with a baseline")
    while not halted():
        iteration = max((e["iteration"] for e in ledger.of("iteration")), default=0) + 1
        reason, parent, allowed = run.stop_or_parent(iteration)
        if reason is None:
            run.iterate(iteration, parent, allowed)
            continue
        best = run.final()
        if halted():
            break
        scores = None
        if final_test:
            ledger.append(type="test_started")
            ids = list(dict.fromkeys([BASELINE, best["candidate_id"]]))
            scores = run.means(ids, "test")
        ledger.append(type="final", stop_reason=reason, chosen_id=best["candidate_id"], test_scores=scores)
        break
    return spark.createDataFrame([Row(**e) for e in ledger.events], ledger.schema)
