"""Anomaly demonstration: clean runs build a history, a perturbed run is flagged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.functions.faults import perturb, random_generate
from trustweave.plans.workspace import Run, Workspace

BOUNDS = "origin INT, boundary INT, length INT, seq LONG"


def generate(run: Run, path: str, amplitude: float, seed: int, inspect: bool) -> DataFrame:
    """One run: load bounds, draw the numbers, perturb them."""
    raw = run.load(path, "raw", BOUNDS)
    columns = ["value"] if inspect else []
    gen = run.capture(random_generate(raw, seed=seed).select("value"), "gen", ["raw"], "GENERATE", columns)
    result = gen.select(perturb(F.col("value"), amplitude).alias("value"))
    return run.capture(result, "result", ["gen"], "PERTURB", columns)


def demonstrate(ws: Workspace, scope: str, path: str, histories: int = 10, amplitude: float = 2.0) -> dict[str, Run]:
    """Clean history runs, then a clean and a perturbed run that are checked."""
    for number in range(histories):
        run = ws.start_run(scope, f"history {number}")
        generate(run, path, 0.0, number, inspect=False)
        run.finish(check=False)
    checked = {}
    for label, factor, seed in (("clean", 0.0, histories), ("perturbed", amplitude, histories + 1)):
        run = ws.start_run(scope, label)
        generate(run, path, factor, seed, inspect=True)
        run.finish()
        checked[label] = run
    return checked
