"""Readers and writers with declared schemas, and configuration."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dims import SKIPPED_KEYS

TRAINING = "text string, labels array<int>, source string"
JOURNAL = "line string"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Delimited files with a header; every column is text, so that card and identity numbers keep their digits."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True, sep=sep, quote='"', escape='"')


def json_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): JSON stays text; nothing is inferred."""
    return whole_texts(spark, path).withColumnRenamed("text", "body")


def json_lines(spark: SparkSession, path: str, schema: str = TRAINING) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def dictionary(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(phrase, type, rank) of a delimited file with a header; a line's place in no way matters. Lists of any size stay tables."""
    return spark.read.schema("phrase string, type string, rank int").csv(path, header=True, sep=sep).where("phrase IS NOT NULL AND type IS NOT NULL").na.fill(0, ["rank"])


def names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a text file with one name a line; blank lines and those that begin with # are no names."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' AND NOT startswith(name, '#')").distinct()


def media(spark: SparkSession, path: str) -> DataFrame:
    """(path, head, length, content): head is the first 16 bytes in hex."""
    return spark.read.format("binaryFile").load(path).select("path", F.hex(F.substring("content", 1, 16)).alias("head"), "length", "content")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files make less than half as many partitions; tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def append(df: DataFrame, path: str) -> None:
    """Snapshots, journals and mappings are appended, never rewritten."""
    df.write.mode("append").parquet(path)


def accepted(requests: DataFrame, limit) -> tuple[DataFrame, DataFrame]:
    """(requests within the limit, (request_id, status 413) of others)."""
    size = F.octet_length("body")
    return requests.where(size <= limit), requests.where(size > limit).select("request_id", F.lit(413).alias("status"))


@dataclass(frozen=True)
class Config:
    """Options of detection and assessment."""

    min_confidence: float = 0.5
    agreement_bonus: float = 0.15
    engine: str = "auto"
    languages: list[str] = field(default_factory=list)
    skipped_keys: list[str] = field(default_factory=lambda: list(SKIPPED_KEYS))
    fail_open: bool = True
    respect_fences: bool = True
    passthrough: bool = False
    sensitivity: str = "medium"
    least_flags: int = 3

    def __post_init__(self) -> None:
        if not 0 <= self.min_confidence <= 1:
            raise ValueError(f"min_confidence {self.min_confidence} isn't in [0, 1]")
        if self.engine not in ("auto", "ner", "crf", "regex"):
            raise ValueError(f"no engine {self.engine!r}")
        if self.sensitivity not in ("off", "low", "medium", "high"):
            raise ValueError(f"no sensitivity {self.sensitivity!r}")


def loaded_config(path: str, environment: dict[str, str] | None = None) -> Config:
    """A configuration file; SPANVEIL_<OPTION> of the environment (a TOML value, or plain text) overrides an option."""
    values = tomllib.loads(Path(path).expanduser().read_text("utf-8"))
    for name, given in (os.environ if environment is None else environment).items():
        option = name.removeprefix("SPANVEIL_").lower()
        if name.startswith("SPANVEIL_") and option in {f.name for f in fields(Config)}:
            try:
                values[option] = tomllib.loads(f"x = {given}")["x"]
            except tomllib.TOMLDecodeError:
                values[option] = given
    return _checked(values)


def config(text: str) -> Config:
    """A configuration from TOML; unknown keys are an error."""
    return _checked(tomllib.loads(text))


def _checked(values: dict) -> Config:
    unknown = values.keys() - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}")
    return Config(**values)
