"""Configurations in YAML or JSON: evaluation, training, ignore lists. YAML needs the yaml module; JSON always works."""

from __future__ import annotations

import json
import warnings
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomspan.sinks.files import read_bytes


def parse(text: str) -> Any:
    """A YAML document, or a JSON one, which needs no further module."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("this configuration isn't JSON, and there is no yaml module to read it") from e
        return yaml.safe_load(text)


def read(spark: SparkSession, path: str) -> Any:
    return parse(read_bytes(spark, path).decode())


class ConfigError(ValueError):
    """What is wrong with a configuration, and where."""


REQUIRED = object()

# Keys, kinds and defaults of the two formats. A list stands for a list of such mappings; a mapping that
# may be given by one key's value alone names that key under "".
EVALUATED = {"": "dataset_name", "dataset_name": (str, REQUIRED), "subset": (str, None), "split": (str, None), "n_samples": (int, None)}
EVALUATION = {"datasets": ([EVALUATED], REQUIRED), "split": (str, "test")}
MIXED = {
    "dataset_name": (str, REQUIRED), "subset": (str, None), "teacher_column": (str, "teacher_score"), "items": (int, None),
    "upsample_factor": (float, None), "n_samples": (float, None),
}
MIX = {
    "datasets": ([MIXED], None), "dataset_name": (str, None), "subset": (str, None), "teacher_column": (str, None), "items": (int, None),
    "upsample_factor": (float, None), "filter_zero_relevance_max_items": (int, None), "filter_zero_relevance_max_items_reverse": (bool, False),
    "filter_keep_first_item": (bool, False), "validation_split": (float, None), "validation_split_samples": (int, None),
    "validation_split_name": (str, "validation"), "max_train_samples": (int, None), "max_eval_samples": (int, None),
}
TRAINING = {"model_args": (dict, {}), "data_args": (MIX, REQUIRED), "training_args": (dict, {})}


def checked(value: Any, kind: Any, at: str = "") -> Any:
    """The value as `kind` says: a mapping by a table of keys, a list of such, or a plain kind. Keys that the table doesn't have
    are left out with a warning; anything else that doesn't fit is a ConfigError that names its place."""
    if isinstance(kind, list):
        if not isinstance(value, list) or not value:
            raise ConfigError(f"{at or 'the configuration'} is a list with one entry at least")
        return [checked(v, kind[0], f"{at}[{i}]") for i, v in enumerate(value)]
    if isinstance(kind, dict):
        if "" in kind and isinstance(value, str):
            value = {kind[""]: value}
        if not isinstance(value, dict):
            raise ConfigError(f"{at or 'the configuration'} is a mapping, not {type(value).__name__}")
        names = {k: v for k, v in kind.items() if k}
        place = lambda k: f"{at}.{k}" if at else k
        for k in value.keys() - names.keys():
            warnings.warn(f"{place(k)} is not known and has no effect", stacklevel=3)
        out = {}
        for k, (inner, default) in names.items():
            given = value.get(k)
            if given is None and default is REQUIRED:
                raise ConfigError(f"{place(k)} is missing")
            out[k] = default if given is None else checked(given, inner, place(k))
        return out
    if kind is dict:
        if not isinstance(value, dict):
            raise ConfigError(f"{at} is a mapping")
        return value
    if kind is bool and not isinstance(value, bool):
        raise ConfigError(f"{at} is true or false")
    try:
        return kind(value)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{at} is {kind.__name__}, not {value!r}") from e


def evaluation_plan(payload: Any, split: str | None = None) -> list[dict[str, Any]]:
    """The datasets of an evaluation, each with its key (name, or name:subset) and its split: its own, else the caller's, else the
    configuration's."""
    plan = checked(payload, EVALUATION)
    key = lambda d: d["dataset_name"] + (f":{d['subset']}" if d["subset"] else "")
    return [{**d, "key": key(d), "split": d["split"] or split or plan["split"]} for d in plan["datasets"]]


def mix_plan(payload: Any) -> dict[str, Any]:
    """The data section of a training configuration, with one dataset at least: those listed, or the one it names itself. A
    dataset's own `items` and `upsample_factor` go before the section's."""
    plan = checked(payload, TRAINING)["data_args"]
    listed = plan["datasets"]
    if not listed:
        if not plan["dataset_name"]:
            raise ConfigError("data_args has neither datasets nor dataset_name")
        listed = [checked({k: plan[k] for k in MIXED if plan.get(k) is not None}, MIXED, "data_args")]
    inherit = lambda d, k: d[k] if d[k] is not None else plan[k]
    plan["datasets"] = [{**d, "items": inherit(d, "items"), "upsample_factor": inherit(d, "upsample_factor")} for d in listed]
    return plan


def ignore_list(spark: SparkSession, payload: Any, lang: str) -> DataFrame:
    """qid, reason of one language's entries; those without a qid are skipped."""
    rows = [(str(e["qid"]), str(e.get("reason", "")).strip()) for e in ((payload or {}).get(lang) or []) if e.get("qid") is not None]
    return spark.createDataFrame(rows, "qid string, reason string")


def merge_ignore_list(payload: Any, lang: str, new: list[dict[str, Any]]) -> dict[str, Any]:
    """The lists with new entries of one language: by qid, the new ones win, the order stays, unknown ones come last."""
    out = dict(payload or {})
    merged = {str(e["qid"]): e for e in out.get(lang) or [] if e.get("qid") is not None}
    merged |= {str(e["qid"]): e for e in new}
    out[lang] = list(merged.values())
    return out
