"""Records as JSON lines, of which broken ones don't count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON objects, one a line, with ``file``; a line that is no object is left out. A value of another
    type than the schema's is null and keeps its row, which a strict reader would drop."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    good = lines.where(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"))
    return good.select("file", F.from_json("value", schema).alias("r")).select("r.*", "file")


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
