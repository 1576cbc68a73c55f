"""What the training-data operators share: row identity, shared-folder tables, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class for regular expressions.
ASCII_SPACE = r"\x20\x09-\x0D"


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent in a local session (tests) a temporary folder stands in; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Makes Spark delete the shuffle files of a statement as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there.

    What was shuffled on the way is of no more use once the table is written, so those files go at once.
    """
    spark = df.sparkSession
    path, before = work_dir(spark), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Empty tables that ``cut`` wrote, once nothing is left to read them."""
    for df in frames:
        df.sparkSession.createDataFrame([], "gone int").write.mode("overwrite").parquet(df.cut_path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body(column)``, without recomputation."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null or empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{ASCII_SPACE}]+"), lambda w: w != "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that identify a row by content: ``k_id`` and a 64-bit hash of the text.

    A null id or text has a fixed stand-in, so that equality joins work. Rows that agree in both
    are exact repeats; operators give them the same result.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("k_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k_text"),
    ]


def utf8(column: Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(column, F.lit("")).cast("binary")


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow array and its row offsets, without copying."""
    wide = pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    return data, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
