"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
WORD_SPACE = b" \t\n\x0b\x0c\r"

#: Lower-cases A-Z only.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator works on, so that further columns of any name can't clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c) for c in more))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; only in one process (tests) a local one is set instead."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or f"/tmp/checkpoints/{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared checkpoint folder: lineage ends there, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def snug(df: DataFrame, rows: int) -> DataFrame:
    """A stored table in as many partitions as its rows fill, so that later stages have no empty tasks."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def held_out(doc_id, folds: int):
    """True where crc32 of the id's decimal text leaves the remainder 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds) == 2, F.lit(False))


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes the empty text."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]
