"""Reports in Markdown and JSON, made from small results: evaluation, long documents, judgements."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.formats import number
from loomspan.operators import evaluate as E
from loomspan.operators import labeling as L
from loomspan.sinks.files import write_text
from loomspan.sinks.save import save

#: Columns of the evaluation table: heading, key, decimals (None: a count).
EVALUATION = (("F2 Score", "f2", 4), ("Recall", "recall", 4), ("Precision", "precision", 4), ("FN", "fn", None), ("TP", "tp", None), ("FP", "fp", None), ("TN", "tn", None), ("Mean Compression (%)", "mean_compression", 2), ("Span Accuracy", "accuracy", 4), ("Contexts", "contexts", None))


def evaluation_markdown(results: Mapping[float, Mapping[str, Mapping[str, Any]]], facts: Mapping[str, Any] | None = None) -> str:
    """One table a threshold, one row a dataset; N/A where a number is undefined."""
    lines = [f"* {k}: {v}" for k, v in (facts or {}).items()]
    lines.append(f"* Thresholds: {', '.join(E.threshold_label(t) for t in results)}")
    for threshold, datasets in results.items():
        lines += ["", f"### Threshold {E.threshold_label(threshold)}", "", "| Dataset | " + " | ".join(h for h, _, _ in EVALUATION) + " |", "|" + "---|" * (len(EVALUATION) + 1)]
        for name, r in datasets.items():
            cells = [str(r.get(k, 0)) if d is None else number(r.get(k), d) for _, k, d in EVALUATION]
            lines.append(f"| {name} | " + " | ".join(cells) + " |")
        if not datasets:
            lines.append("| (no datasets) |" + " N/A |" * len(EVALUATION))
    return "\n".join(lines)


def write_evaluation(spark: SparkSession, path: str, results: Mapping[float, Mapping[str, Mapping[str, Any]]], facts: Mapping[str, Any] | None = None) -> None:
    """report.md and report.json in a folder."""
    write_text(spark, f"{path}/report.md", evaluation_markdown(results, facts))
    flat = [{"threshold": t, "dataset": name, **r} for t, datasets in results.items() for name, r in datasets.items()]
    write_text(spark, f"{path}/report.json", json.dumps({"facts": dict(facts or {}), "results": flat}, indent=2, ensure_ascii=False))


def long_document_markdown(records: DataFrame, first: int = 5) -> str:
    """The first queries by id with their passages: positives first, then by score. So few that they fit the driver."""
    rows = E.report_rows(records, first).orderBy("query_id", "place").collect()
    lines, last = ["# Long documents"], None
    for r in rows:
        if r["query_id"] != last:
            lines += ["", f"## {r['query_id']}: {r['query']}", "", "| Place | Positive | Score | Compression (%) | Title |", "|---|---|---|---|---|"]
            last = r["query_id"]
        lines.append(f"| {r['place']} | {'yes' if r['label'] == 1 else 'no'} | {number(r['reranking_score'])} | {number(r['compression_rate'], 2)} | {r['title'] or ''} |")
    return "\n".join(lines) + "\n"


def write_judgements(judged: DataFrame, path: str, facts: Mapping[str, Any] | None = None, skipped: int = 0) -> dict[str, Any]:
    """The judged records (records/), summary.json and summary.md in a folder. Returns the summary."""
    spark = judged.sparkSession
    save(judged, f"{path}/records", overwrite=True)
    s = L.judge_summary(spark.read.parquet(f"{path}/records")).first()
    scored = s["mean_score"] is not None
    summary: dict[str, Any] = {
        **(facts or {}), "records_evaluated": s["answered"] + s["unanswered"] + s["failed"], "ignored_count": skipped,
        "counts": {"has_answer_1": s["answered"], "has_answer_0": s["unanswered"], "failed": s["failed"]},
        "answer_score_stats": {"mean": s["mean_score"], "median": s["median_score"], "min": s["least"], "max": s["most"]} if scored else None,
    }
    write_text(spark, f"{path}/summary.json", json.dumps(summary, indent=2, ensure_ascii=False))
    lines = ["# Judgements", "", *[f"- {k}: {v}" for k, v in (facts or {}).items()], f"- Records: {summary['records_evaluated']}, ignored queries: {skipped}"]
    lines += [f"- Has answer: {s['answered']}, no answer: {s['unanswered']}, failed: {s['failed']}"]
    if scored:
        lines += ["", "## Scores", *[f"- {k}: {number(v)}" for k, v in summary["answer_score_stats"].items()]]
    write_text(spark, f"{path}/summary.md", "\n".join(lines) + "\n")
    return summary


def rows_by(df: DataFrame, key: str, columns: Sequence[str]) -> dict[str, dict[str, Any]]:
    """A small result, one row a key, as a mapping."""
    return {str(r[key]): {c: r[c] for c in columns} for r in df.select(F.col(key), *columns).collect()}
