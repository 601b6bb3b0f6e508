"""Table readers with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON Lines with a given schema; blank lines give no row."""
    return spark.read.schema(schema).json(path)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row per `{doc_id}.md` file."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1)
    return (
        spark.read.option("pathGlobFilter", "*.md")
        .text(path, wholetext=True)
        .select(name.alias("doc_id"), F.col("value").alias("text"))
    )


def read_or_empty(
    spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet"
) -> DataFrame:
    """The table at `path`, or an empty one of the schema when there is none."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
