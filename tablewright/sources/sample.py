"""A Python data source with the fixed sample rows used for dry runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed sample rows.
SAMPLE_ROWS = [(1, 100), (2, 150)]


class _SampleReader(DataSourceReader):
    def partitions(self):
        return [InputPartition(i) for i in range(len(SAMPLE_ROWS))]

    def read(self, partition):
        yield SAMPLE_ROWS[partition.value]


class SampleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tablewright_sample"

    def schema(self) -> str:
        return "id long, metric long"

    def reader(self, schema) -> DataSourceReader:
        return _SampleReader()


def read_sample(spark: SparkSession) -> DataFrame:
    spark.dataSource.register(SampleSource)
    return spark.read.format(SampleSource.name()).load()
