"""python -m spanveil detect|redact IN OUT [--config FILE]: JSON lines with doc_id and text in, JSON lines out."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import api
from .sources import io


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spanveil", description=__doc__)
    parser.add_argument("what", choices=["detect", "redact", "scan-response"])
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--config", help="a TOML file")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    config = io.loaded_config(given.config) if given.config else io.Config()
    docs = io.json_lines(spark, given.source, "doc_id long, text string")
    work = {"detect": api.detect, "redact": lambda d, c: api.redact(d, config=c), "scan-response": api.scan_response}[given.what]
    io.write_json_lines(work(docs, config), given.target)


if __name__ == "__main__":
    main()
