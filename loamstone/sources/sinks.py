"""Writers of results and reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line, in a folder of part files."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(report: dict, path: str) -> None:
    """One pretty JSON file, swapped in whole."""
    with open(f"{path}.new", "w") as f:
        json.dump(report, f, indent=2, sort_keys=True, default=str)
    os.replace(f"{path}.new", path)
