"""What the operators share: reading, word splitting, staged tables, Arrow mapping."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from samefold.storage import persisted as staged  # noqa: F401  (the operators take it from here)
from samefold.storage import spread

#: Rows in an Arrow batch: a batch of long texts stays within tens of megabytes.
BATCH_ROWS = 512

#: Bytes of UTF-8 that are not part of a word go to a blank, A-Z to a-z; bytes over 0x7F stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a file of fewer splits than there are cores is dealt out over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty, lone surrogates become '?'."""
    return text.encode("utf-8", "replace") if text else b""


def folded_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, as UTF-8."""
    return utf8(text).translate(_FOLD).split()


def spaced_words(data: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes; bytes.split() knows the same six separators."""
    return data.split()


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns inside one column __x, where no name of theirs can meet
    one that an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(True)).alias("__x"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the table that packed() was given."""
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col("__x").getField(c).alias(c) for c in columns))


def fields(ddl: str, df: DataFrame, *columns: str) -> StructType:
    """A schema: the fields of ddl, then columns of df."""
    out = StructType.fromDDL(ddl)
    return StructType([*out.fields, *(df.schema[c] for c in columns)])


def arrow_map(df: DataFrame, schema: str | StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """mapInArrow with one function call for each batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
