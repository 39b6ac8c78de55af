"""Writing results as typed CSV, as one file or as parts; read_typed_csv reads both back."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.header import format_field, format_header


def write_typed_csv(df: DataFrame, path: str) -> str:
    """One local file with a typed header; rows stream through the driver in the order of df."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(format_header(df.schema) + "\n")
        for row in df.toLocalIterator(prefetchPartitions=True):
            f.write(",".join(map(_text, row)) + "\n")
    return path


def write_typed_csv_parts(df: DataFrame, path: str) -> str:
    """A folder of part files written by the executors, each with the typed header, in the order of df's partitions."""
    named = df.select([_shown(f).alias(format_field(f)) for f in df.schema])
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    named.write.mode("overwrite").options(**options).csv(path)
    return path


def _shown(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return c if isinstance(f.dataType, (T.NumericType, T.StringType)) else c.cast("string")


def _text(v) -> str:
    if v is None:
        return ""
    if isinstance(v, float):
        return repr(v) if math.isfinite(v) else "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    text = str(v)  # of a timestamp: with a fraction where there is one
    plain = text == text.strip() and not any(x in text for x in '",\r\n') and text
    return text if plain else '"' + text.replace('"', '""') + '"'
