"""Evaluations and training mixes as configurations describe them, from the files to the result."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import datasets as D
from loomspan.operators import evaluate as E
from loomspan.sinks.reports import write_evaluation
from loomspan.sources import configs
from loomspan.sources.datasets import head, load_dataset, load_split

METRICS = ("contexts", "tp", "fp", "tn", "fn", "span_skipped", "accuracy", "precision", "recall", "f2", "mean_compression")


def evaluate(spark: SparkSession, payload: Any, root: str, thresholds: list[float], targets: list[str] | None = None, split: str | None = None, order: str = "id", report: str | None = None, **options) -> DataFrame:
    """dataset, threshold and METRICS for each dataset of an evaluation's configuration and each threshold. A dataset lies in
    root/dataset_name(/subset); n_samples takes its first rows by `order`. targets: keys of the datasets to take; report: a
    folder for the report, written once all rows are there; options: those of prune()."""
    plan = configs.evaluation_plan(payload, split)
    wanted = set(E.pick_targets([d["key"] for d in plan], targets))
    out = None
    for d in (d for d in plan if d["key"] in wanted):
        rows = load_split(load_dataset(spark, f"{root}/{d['dataset_name']}", d["subset"]), d["split"])
        told = E.evaluate_spans(head(rows, d["n_samples"], order), thresholds, **options).select(F.lit(d["key"]).alias("dataset"), "threshold", *METRICS)
        out = told if out is None else out.unionByName(told)
    if report is not None:
        results: dict[float, dict[str, dict[str, Any]]] = {float(t): {} for t in thresholds}
        rows = out.collect()  # one a dataset and threshold
        for r in rows:
            results[r["threshold"]][r["dataset"]] = {k: r[k] for k in METRICS}
        write_evaluation(spark, report, results)
        out = spark.createDataFrame(rows, out.schema)
    return out


def mix(spark: SparkSession, payload: Any, root: str, seed: int = 42, id_column: str = "id") -> tuple[DataFrame, DataFrame | None]:
    """(training rows, validation rows) of a training configuration's data section, whose datasets lie in
    root/dataset_name(/subset) with the splits `train` and, if they have it, validation_split_name."""
    plan = configs.mix_plan(payload)
    parts = []
    for d in plan["datasets"]:
        rows = load_dataset(spark, f"{root}/{d['dataset_name']}", d["subset"])
        of = lambda name, rows=rows: rows.where(F.col("split") == name).drop("split")
        held = of(plan["validation_split_name"])
        parts.append(D.Part(of("train"), held if held.limit(1).count() else None, (id_column,), d["teacher_column"] or plan["teacher_column"], d["upsample_factor"], d["n_samples"], d["items"]))
    return D.prepare(
        parts, seed, None, plan["filter_zero_relevance_max_items"], reverse=plan["filter_zero_relevance_max_items_reverse"], keep_first=plan["filter_keep_first_item"],
        validation=plan["validation_split_samples"] or plan["validation_split"], max_train=plan["max_train_samples"], max_validation=plan["max_eval_samples"],
    )
