"""Settings of a run from a file, as attributes."""

from __future__ import annotations

import json
from types import SimpleNamespace
from typing import Any

from pyspark.sql import SparkSession


def _attributes(value: Any) -> Any:
    if isinstance(value, dict):
        return SimpleNamespace(**{str(k): _attributes(v) for k, v in value.items()})
    return [_attributes(v) for v in value] if isinstance(value, list) else value


def load_config(spark: SparkSession, path: str) -> SimpleNamespace:
    """The settings of a JSON or, where a reader for it is installed, YAML file; nested ones are attributes of attributes."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        import yaml

        return _attributes(yaml.safe_load(text))
    return _attributes(json.loads(text))
