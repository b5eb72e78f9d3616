"""Configuration and reloads: tool schemas, rates and keys, stages that earlier runs left."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # YAML is optional: JSON is YAML too
    import yaml
except ModuleNotFoundError:
    yaml = None

DEFAULT_RPM = 20


def parse(text: str) -> dict:
    return yaml.safe_load(text) if yaml else json.loads(text)


def tool_section(text: str) -> str:
    """The prompt section that announces the tools of a schema file."""
    schemas = "\n".join(json.dumps(tool.get("tool_schema", {}), ensure_ascii=False) for tool in parse(text).get("tools", []))
    # The wording that models were trained on.
    return (
        "# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
        f"You are provided with function signatures within <tools></tools> XML tags:\n<tools>\n{schemas}\n</tools>\n\n"
        "For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n"
        '<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
    )


def rates(text: str | None) -> dict[str, float]:
    """Requests a minute by model; whatever cannot be read gives the default alone."""
    try:
        found = parse(text or "")["model_rpm"]
        return {"default": DEFAULT_RPM} | {str(k): float(v) for k, v in found.items()}
    except Exception:  # a broken file is no reason to stop
        return {"default": DEFAULT_RPM}


def api_keys(listed: str) -> list[str]:
    return [key.strip() for key in listed.split(",") if key.strip()]


def output_name(prefix: str, now: datetime) -> str:
    return f"{prefix}_{now:%Y%m%d_%H%M%S}"


def read_stage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stage's JSON rows, an array a file or an object a line."""
    return spark.read.schema(schema).json(path, multiLine=True) if path.endswith(".json") else spark.read.schema(schema).json(path)


def questions_path(folder: str, listed: set[str]) -> str:
    """The file of questions in a folder of results: the raw ones if they are there."""
    for name in ("questions_raw.json", "synthesis_final_results.json"):
        if name in listed:
            return os.path.join(folder, name)
    raise FileNotFoundError(f"no questions in {folder}")


def described_entities(entities: DataFrame) -> DataFrame:
    """Entities of a stage file that have a name and a description."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return entities.where(filled("name") & filled("description"))
