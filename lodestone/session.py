"""The engine: a catalog of tables and one way to ask SQL of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.sink import write_typed_csv, write_typed_csv_parts
from lodestone.sources.tables import load_directory, read_typed_csv, stem


def build_session(app: str = "lodestone", **conf: str) -> SparkSession:
    """A session with the settings that the engine relies on; a running session is used as it is."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.timestampType": "TIMESTAMP_NTZ"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


class Engine:
    """Tables by name, and SQL over them. Planning and execution are Spark's; semantics are ANSI."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.names: list[str] = []

    def register(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        self.names = sorted({*self.names, name})
        return df

    def load_csv(self, path: str) -> DataFrame:
        return self.register(stem(path), read_typed_csv(self.spark, path))

    def load_dir(self, directory: str) -> list[str]:
        for name, df in load_directory(self.spark, directory).items():
            self.register(name, df)
        return self.names

    def tables(self) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables() if t.isTemporary]

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def explain(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def preview(self, df: DataFrame, n: int = 20, width: int = 30) -> None:
        df.show(n, truncate=width)

    def write_result(self, df: DataFrame, path: str) -> str:
        """A folder of parts, written by the executors; one local file, through the driver, where the path ends in .csv."""
        return (write_typed_csv if path.endswith(".csv") else write_typed_csv_parts)(df, path)
