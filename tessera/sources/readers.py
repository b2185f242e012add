"""Tables in and out: Parquet, XML, text trees, JSON, binary files, and an application's own source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """Spark's XML reader: a row for each element of a name."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: path and text, for ``nodes.import_documents`` and the like."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def write_json(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.option("compression", compression).json(path)


def encode_base64(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.base64(column))


def decode_base64(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.unbase64(column))


class Rows(InputPartition):
    def __init__(self, number: int):
        self.number = number


def application_source(name: str, schema: str, parts: int, rows: Callable[[int], Iterator[tuple]]) -> type[DataSource]:
    """A Python data source whose part n yields ``rows(n)``; register it with ``spark.dataSource.register``."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Rows(i) for i in range(parts)]

        def read(self, partition: Rows) -> Iterator[tuple]:
            yield from rows(partition.number)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source
