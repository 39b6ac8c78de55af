"""The typed header line of a CSV file: ``name (T) (P), other (N)``.

Tags: N number (double), T text (string), D timestamp (timestamp without zone),
P primary key (kept as field metadata, not enforced).
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

TYPES = {"N": T.DoubleType(), "T": T.StringType(), "D": T.TimestampNTZType()}
TAGS = {type(kind): tag for tag, kind in TYPES.items()}


class HeaderError(ValueError):
    """The first line does not declare a schema."""


def parse_header(line: str) -> T.StructType:
    """The schema that a header line declares; raises HeaderError if it declares none."""
    fields = []
    for token in line.rstrip("\r\n").lstrip("﻿").split(","):
        name, paren, rest = token.strip().removeprefix('"').removesuffix('"').partition("(")
        if not paren:
            raise HeaderError(f"no type tag in {token!r}")
        tags = re.findall(r"\(([^()]*)\)", paren + rest)
        if re.sub(r"\([^()]*\)", "", paren + rest).strip():
            raise HeaderError(f"unbalanced parenthesis in {token!r}")
        tags = [t.strip() for t in tags]
        if unknown := [t for t in tags if t != "P" and t not in TYPES]:
            raise HeaderError(f"unknown tag {unknown[0]!r} in {token!r}")
        kinds = [t for t in tags if t in TYPES]
        if not kinds:
            raise HeaderError(f"no type tag in {token!r}")
        meta = {"primary_key": "P" in tags, "source_type": kinds[-1]}
        fields.append(T.StructField(name.strip(" \t"), TYPES[kinds[-1]], True, meta))
    return T.StructType(fields)


def format_header(schema: T.StructType) -> str:
    """The header line for a schema; types without a tag of their own are mapped to the nearest."""
    return ",".join(format_field(f) for f in schema)


def format_field(f: T.StructField) -> str:
    return f"{f.name} ({tag_of(f.dataType)})" + " (P)" * bool(f.metadata.get("primary_key"))


def tag_of(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "N"
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return "D"
    return "T"
