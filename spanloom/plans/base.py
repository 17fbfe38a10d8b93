"""Tables that the queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import judge, scan
from spanloom.operators.rules import CORPUS

#: Pickers of the judge without a model: pattern, grade, category, risk.
PICKERS = [("token = ", "A", "secret", True), ("[0-9]{2,}", "B", "number", False), ("rights reserved", "B", "status", True), ("!!", "C", "emphasis", False), ("tion[a-z]+", "A", "word", False)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer partitions than there are; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.segments(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(segments(spark, sf_dir), CORPUS)


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned segments that are worth judging."""
    return scan.prescreen(scanned(spark, sf_dir))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.pick_judge(segments(spark, sf_dir), PICKERS)
