"""Loading tables: typed CSV files, parquet, whole directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import parse_moment
from lodestone.sources.header import parse_header

CORRUPT = "_corrupt_record"


def read_typed_csv(spark: SparkSession, path: str, *, keep_corrupt: bool = False, multiline: bool | None = None) -> DataFrame:
    """A CSV file, or a folder of them, with a typed header line in each. Quoting as in RFC 4180, LF or CRLF.

    Numbers and timestamps that don't parse, and the missing ends of short rows, are null; blanks around them are
    ignored. Text is kept as it is; empty text is ''. With keep_corrupt, the column _corrupt_record has the lines that
    did not parse. multiline says whether quoted texts hold line ends: such files are not split among tasks. Where it
    is not given, one pass looks for a line with an odd number of quotes and stops at the first.
    """
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no header line")
    declared = parse_header(first[0][0])
    if multiline is None:
        multiline = not lines.filter((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1).isEmpty()
    # moments are read as text: their format is the same whatever the session's time zone
    raw = T.StructType([*(T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType) for f in declared), T.StructField(CORRUPT, T.StringType())])
    options = {"header": True, "enforceSchema": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"', "multiLine": multiline}
    df = spark.read.schema(raw).options(**options).csv(path)
    columns, bad = [], F.lit(False)
    for f in declared:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, T.TimestampNTZType):
            text, c = c, parse_moment(c)
            bad |= (F.trim(text) != "") & c.isNull()
        columns.append(c.alias(f.name, metadata=f.metadata))
    if keep_corrupt:
        columns.append(F.coalesce(F.col(CORRUPT), F.when(bad, F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in declared])))).alias(CORRUPT))
    return df.select(columns)


def read_plain_csv(spark: SparkSession, path: str, *, header: bool = True) -> DataFrame:
    """A CSV file without types: every column is text, named by the first line or _c0, _c1, ..."""
    return spark.read.option("header", header).option("quote", '"').option("escape", '"').csv(path)


def read_queries(spark: SparkSession, directory: str) -> dict[str, str]:
    """The text of every file of a directory, by file stem, in the order of the names."""
    return {stem(p): spark.read.text(p, wholetext=True).first()[0] for p in list_files(spark, directory, "")}


def list_files(spark: SparkSession, directory: str, suffix: str) -> list[str]:
    """Paths in a directory that end in suffix, by Hadoop's file systems, so any store works."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(path) if s.getPath().getName().endswith(suffix))


def stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return read_typed_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def load_directory(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = (".csv", ".parquet")) -> dict[str, DataFrame]:
    """Every table file of a directory, by file stem."""
    return {stem(p): read_table(spark, p) for s in suffixes for p in list_files(spark, directory, s)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
