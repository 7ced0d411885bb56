"""Source text to concepts and call candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.extract import braces, python_source

CONCEPTS = "id string, kind string, language string, name string, qualified_name string, file string, start_line int, end_line int, signature string, is_public boolean"
CALLS = "caller_id string, callee_name string, language string, file string, line int, character int"
IMPORTS = "src string, target string"


def extract_source(path: str, language: str, text: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Concepts (the module first), call candidates and imports of one file."""
    return (python_source if language == "Python" else braces).extract(path, language, text)


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for a table (path, language, text), as three tables; each file is parsed once."""
    row = f"array<struct<{', '.join(p.replace(' ', ': ', 1) for p in CONCEPTS.split(', '))}>>"
    call = f"array<struct<{', '.join(p.replace(' ', ': ', 1) for p in CALLS.split(', '))}>>"
    imp = f"array<struct<{', '.join(p.replace(' ', ': ', 1) for p in IMPORTS.split(', '))}>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [extract_source(*x) for x in zip(pdf["path"], pdf["language"], pdf["text"])]
            yield pd.DataFrame(got, columns=["concepts", "calls", "imports"])

    rows = files.select("path", "language", "text").mapInPandas(run, f"concepts {row}, calls {call}, imports {imp}").cache()
    return tuple(rows.select(F.explode(c).alias("x")).select("x.*") for c in ("concepts", "calls", "imports"))
