"""Stages in order: load, check, standardise, match, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tessera.operators import frames, matching, quality

STAGES: dict[str, tuple[Callable, set[str], set[str]]] = {}


def stage(name: str, consumes: tuple[str, ...], produces: tuple[str, ...]):
    def add(f):
        STAGES[name] = (f, set(consumes), set(produces))
        return f

    return add


@dataclass
class Run:
    config: dict
    data: dict[str, DataFrame]
    log: list[str] = field(default_factory=list)


@stage("check", ("table",), ("findings",))
def check(run: Run):
    run.data["findings"] = quality.boosted(quality.scan(run.data["table"]))


@stage("flow", ("table",), ("table",))
def flow(run: Run):
    t, run.data["fixes"] = frames.auto_fix(run.data["table"])
    run.data["table"] = frames.standardize(t, run.config.get("standardize", {}))


@stage("match", ("table",), ("clusters", "golden"))
def match(run: Run):
    c = run.config["match"]
    r = matching.dedupe(run.data["table"], c["id"], c["passes"], c["fields"], c["threshold"], c["rules"])
    run.data |= {"clusters": r.clusters, "golden": r.golden, "pairs": r.scored_pairs}


def plan(names: list[str]) -> list[str]:
    """The stages in the given order, after checking that each finds what it needs."""
    have = {"table"}
    for n in names:
        if n not in STAGES:
            raise NotImplementedError(f"unknown stage {n!r}")
        _, needs, gives = STAGES[n]
        if needs - have:
            raise ValueError(f"{n} needs {', '.join(sorted(needs - have))}")
        have |= gives
    return names


def run(df: DataFrame, config: dict, stages: list[str] = ("check", "flow", "match"), stop_below: int | None = None) -> Run:
    """Runs the stages; with ``stop_below`` a health score under it ends the run after the check."""
    r = Run(config, {"table": df})
    for n in plan(list(stages)):
        STAGES[n][0](r)
        r.log.append(n)
        if n == "check" and stop_below is not None:
            score = quality.health(r.data["findings"]).first().score
            if score < stop_below:
                r.log.append(f"stopped: health {score}")
                break
    return r
