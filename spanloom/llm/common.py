"""Helpers that the corpus operators share: tables, scratch space, byte tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks of the word pattern ``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` uses the same set.
BLANKS = "\\x20\\x09-\\x0D"
#: Characters that end a word of the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
NON_WORD = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"

#: Byte translation: A-Z to a-z, other ASCII outside [0-9a-z] to a space, bytes above 0x7F kept.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

#: Largest Arrow batch handed to a Python worker, in bytes; one longer text still makes one batch.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named Parquet table, with only the given columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer partitions than there are; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one, but only
    if driver and executors are one machine, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; Spark's cleaner removes it when it is out of use."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner remove shuffles and checkpoints that nothing refers to: it learns of them only from the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def packed(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> Column:
    """All columns of docs as one struct, or only the id and the text: names inside a struct clash with nothing."""
    return F.struct(*[F.col(f"`{c}`") for c in (docs.columns if whole else (id_col, text_col))])


def encoded(value) -> bytes:
    """UTF-8 bytes of an Arrow string value; null counts as empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


_caches: list = []
_owner: list[str] = [""]


def cache() -> dict:
    """A dictionary that a worker keeps for one operator's tasks; see claim()."""
    _caches.append({})
    return _caches[-1]


def claim(owner: str) -> None:
    """Workers are used again for other operators: what they remember for the last one is let go first."""
    if _owner[0] != owner:
        for c in _caches:
            c.clear()
        _owner[0] = owner
