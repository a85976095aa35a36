"""What the stages of a pruning job did and how long they took, measured in the job itself.

Each row carries the clock's reading at the border of two stages; when the rows leave the last one, their differences are
added up by DataFrame.observe, with the counts of contexts, sentences, fragments and blocks. So the numbers belong to the
rows that the action saw, cost no further job, and are there once the action is done. Seconds are those of tasks: tasks that
run side by side add up to more than the wall clock tells. Rows of tasks that ran twice may count twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The names that results have, and the stages that each of them holds.
STAGES = ("sentence_collect", "sentence_normalize", "tokenize", "fragment_split", "fragment_decode", "assembly", "inference", "postprocess")
PREPROCESS = STAGES[:5]
COUNTS = ("contexts", "sentences", "fragments", "blocks")


def clock() -> Column:
    """Nanoseconds, read anew for each row."""
    return F.call_function("reflect", F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


class Trace:
    """Give one to prune(trace=...), run an action on its result, then ask seconds() and counts(). For one action."""

    def __init__(self) -> None:
        self.observation = Observation()
        self.done: list[str] = []

    def begin(self, d: DataFrame) -> DataFrame:
        return d.withColumn("at begin", clock())

    def tick(self, d: DataFrame, stage: str) -> DataFrame:
        """The end of a stage; stages end in the order of STAGES, some may be missing."""
        self.done.append(stage)
        return d.withColumn(f"at {stage}", clock())

    def end(self, d: DataFrame, **counts: Column) -> DataFrame:
        marks = ["begin", *self.done]
        spent = [F.coalesce(F.sum((F.col(f"at {b}") - F.col(f"at {a}")) / 1e9), F.lit(0.0)).alias(b) for a, b in zip(marks, marks[1:])]
        told = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"n {name}") for name, c in counts.items()]
        return d.observe(self.observation, F.count(F.lit(1)).alias("n contexts"), *spent, *told).drop(*[f"at {m}" for m in marks])

    def seconds(self) -> dict[str, float]:
        """Task seconds by stage, and those of preprocessing and of all."""
        got = self.observation.get
        out = {s: float(got.get(s, 0.0)) for s in STAGES}
        named = {f"{s}_seconds": v for s, v in out.items()}
        return {"preprocess_seconds": sum(out[s] for s in PREPROCESS), **named, "total_seconds": sum(out.values())}

    def counts(self) -> dict[str, int]:
        got = self.observation.get
        return {c: int(got.get(f"n {c}", 0)) for c in COUNTS}
