"""Recursion to a fixed point with set semantics, which Spark's recursive statements don't have."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Rounds after which a recursion is taken to have no end.
MOST_ROUNDS = 1000


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = MOST_ROUNDS) -> DataFrame:
    """base UNION step(new rows) UNION ...: rows that were there before are dropped each round. Each round's rows are
    written to the session's checkpoint folder, so neither the plan nor recomputation grows with the rounds."""
    context = base.sparkSession.sparkContext
    if not (context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    new = base.distinct().checkpoint()
    seen = new
    for _ in range(rounds):
        new = step(new).distinct().exceptAll(seen).checkpoint()
        if new.isEmpty():
            return seen
        seen = seen.union(new)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
