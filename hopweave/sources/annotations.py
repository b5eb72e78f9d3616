"""Scans of annotation files: JSON arrays and permissive JSONL, by dataset configuration."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.functions.text import first_user_question
from hopweave.operators.scoring import check_methods

RAW = (
    "prompt array<struct<role:string,content:string>>, reward_model struct<ground_truth:array<string>>, image array<string>, "
    "image_search_title_list array<string>, image_search_thumbnail_list array<string>"
)


@dataclass
class DatasetConfig:
    name: str
    annotation: str
    root: str = ""
    reward_fn: list[str] = field(default_factory=list)
    unused_reward_fn: list[str] = field(default_factory=list)
    system_prompt: str = ""
    format_instruction: str = ""

    @property
    def methods(self) -> list[str]:
        return check_methods([*self.reward_fn, *self.unused_reward_fn])


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(idx, row) of a JSON array or JSONL file.

    The first line that is not blank decides.  JSONL may have trailing commas
    and bare brackets; a broken line is skipped but uses its index up.  Lines
    are numbered over the whole file, which one task reads.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\A\s+", "").alias("value"))
    array = F.when(F.startswith("value", F.lit("[")), F.from_json("value", f"array<{schema if schema.startswith('struct') else f'struct<{schema}>'}>"))
    as_array = whole.where(array.isNotNull()).select(F.posexplode(array).alias("idx", "row"))
    bare = F.transform(F.split("value", "\n"), lambda line: F.regexp_replace(F.trim(line), r",\s*$", ""))
    used = F.filter(bare, lambda line: ~line.isin("", "[", "]"))
    lines = whole.where(array.isNull()).select(F.posexplode(used).alias("idx", "line"))
    parsed = lines.where(F.try_parse_json("line").isNotNull()).select("idx", F.from_json("line", schema).alias("row"))
    return as_array.unionByName(parsed).where("row IS NOT NULL")


def joined_path(root: Column, path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")) | (root == ""), path).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path))


def samples(rows: DataFrame, config: DatasetConfig) -> DataFrame:
    """The fixed columns of a sample from raw rows (idx, row)."""
    row = lambda name: F.col(f"row.{name}")
    return rows.select(
        F.concat_ws("-", F.lit(config.name), "idx").alias("id"),
        first_user_question(row("prompt")).alias("question"),
        F.coalesce(row("reward_model.ground_truth"), F.array(F.lit(""))).alias("answer"),
        joined_path(F.lit(config.root), F.get(row("image"), F.lit(0))).alias("image_path"),
        F.lit(config.name).alias("dataset"),
        F.struct(F.slice(row("image_search_title_list"), 1, 5).alias("titles"), F.slice(row("image_search_thumbnail_list"), 1, 5).alias("thumbnails")).alias("image_search_data"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def load_datasets(spark: SparkSession, configs: list[DatasetConfig], data_root: str = "") -> DataFrame:
    """All datasets' samples; a missing annotation file leaves its dataset out."""
    parts = []
    for config in configs:
        config.methods  # noqa: B018  unknown scorers are an error before anything is read
        path = config.annotation if config.annotation.startswith("/") or "://" in config.annotation or not data_root else f"{data_root}/{config.annotation}"
        if exists(spark, path):
            parts.append(samples(json_rows(spark, path, RAW), config))
    if not parts:
        raise FileNotFoundError("no dataset has an annotation file")
    return reduce(DataFrame.unionByName, parts)


def config_table(spark: SparkSession, configs: list[DatasetConfig]) -> DataFrame:
    """Dimension table of the datasets; its size is the configuration's."""
    return spark.createDataFrame(
        [(c.name, c.root, c.annotation, c.methods, c.system_prompt, c.format_instruction) for c in configs],
        "dataset string, root string, annotation string, methods array<string>, system_prompt string, format_instruction string",
    )


def local_qa(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return json_rows(spark, path, schema).select("row.*")


def env_list(value: str | None) -> list[str]:
    """Comma-separated values, trimmed, blanks left out."""
    return [part.strip() for part in (value or "").split(",") if part.strip()]


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, data_uri) of image files."""
    from hopweave.functions.text import image_mime

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.concat(F.lit("data:"), image_mime(F.col("path")), F.lit(";base64,"), F.base64("content")).alias("data_uri"))
