"""Helpers that several operators of this package use."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when it was measured to have no more rows and bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20
#: Rows of one key that a shuffled join may bring into a task; keys with more of them are few and are broadcast.
HOT_ROWS = 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local master gets a temporary one; on a cluster it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="chorale-"))
    return sc.getCheckpointDir()


def table(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: what follows starts from files, not from lineage."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if its input comes in fewer partitions than there are cores, as files of one large row group do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def row_bytes(df: DataFrame) -> tuple[int, list[Column]]:
    """What a row of df takes in memory: a fixed part, and what its strings, binaries and collections hold, about."""
    held = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            held.append(F.octet_length(c))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            held.append(F.octet_length(F.to_json(F.struct(c))))
    return 16 + 8 * len(df.columns), [F.coalesce(c, F.lit(0)).cast("long") for c in held]


def total_bytes(df: DataFrame, rows: int) -> int:
    """Bytes of df, a written table or cheap to compute, that was counted to have so many rows."""
    fixed, held = row_bytes(df)
    return rows * fixed + ((df.agg(F.sum(sum(held, F.lit(0)))).first()[0] or 0) if held and rows else 0)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it was counted and measured to be small; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and total_bytes(df, rows) <= BROADCAST_BYTES else df


def with_known(rows: DataFrame, known: DataFrame, key: list[str], weight: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with the columns of known, a written table of one row for each key of rows; weight says how many rows the key has.

    known is broadcast if it was measured to be small. Otherwise keys with many rows, of which there can only be few, are
    broadcast, and the others are joined by shuffle; should those keys take too many bytes, the ones with the most rows are.
    Keys aren't null; rows without a match get nulls.
    """
    fixed, held = row_bytes(known)
    size, of = sum(held, F.lit(fixed).cast("long")), F.col(weight)
    n, total, taken = known.agg(F.count(F.lit(1)), F.sum(of), F.sum(size)).first()
    if n <= BROADCAST_ROWS and (taken or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(known), key, "left")
    least = max(hot_rows, -(-total // BROADCAST_ROWS))
    steps = [least << k for k in range(max(1, (total // least).bit_length() + 1))]  # no key has more rows than the last step
    parts = known.where(of > least).agg(*[F.coalesce(F.sum(F.when(of > m, size)), F.lit(0)) for m in steps]).first()
    most = next(m for m, part in zip(steps, parts, strict=True) if part <= BROADCAST_BYTES)
    hot = F.broadcast(known.where(of > most))
    spread = rows.join(hot.select(*key), key, "left_anti").join(known.where(of <= most), key, "left")
    return rows.join(hot, key).unionByName(spread)


def lower_az(c: Column) -> Column:
    """A-Z in lower case and nothing else. lower() does just that where all is ASCII; translate() is for the rest."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()


def runs(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Slices of the batch with about limit bytes of the binary column each, one row at least."""
    if not batch.num_rows:
        return
    off = offsets(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def offsets(arr: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    if not len(arr):
        return np.zeros(1, np.int64)
    return np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array without nulls as one array, and where each value starts and ends in it."""
    off, data = offsets(arr), arr.buffers()[2] if len(arr) else None
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]
