"""Shared pieces: shared-folder tables, hash buckets, text buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import HEAVY, LIGHT, heavy_keys, pieces_of, spread_join
from ..storage import drop_staged, map_batches, shared_dir, ship, staged

__all__ = ["HEAVY", "LIGHT", "WORD", "bucket_bits", "counted_heavy", "drop_staged", "hash_bucket", "heavy_keys", "map_batches", "pieces_of", "read", "shared_dir", "ship", "slices", "spread_join", "staged", "utf8"]

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucket_bits(rows: int, per_bucket: int = 2048, least: int = 6, most: int = 30) -> int:
    """Bits so that 2**bits hash buckets hold about per_bucket rows each."""
    return max(least, min(most, (max(rows, 1) // per_bucket).bit_length()))


def hash_bucket(hashed: Column, bits: int) -> Column:
    """The top bits of a 64-bit hash: equal-width ranges of hash order."""
    return F.shiftrightunsigned(hashed, 64 - bits)


def counted_heavy(counts: DataFrame, key: str, n: str = "n") -> list[tuple]:
    """(key, pieces) of a written table of keys with their number of rows n: those with more than 1/HEAVY of all these rows, so fewer than HEAVY."""
    total = int(counts.agg(F.sum(n)).first()[0] or 0)
    most = max(LIGHT, total // HEAVY)
    return [(r[0], -(-r[1] // most)) for r in counts.where(F.col(n) > most).select(key, n).collect()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1_000_000):
    """Consecutive slices of a batch whose texts hold about most_bytes at most (one row at least)."""
    sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    ends = np.diff(np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]).cumsum() if len(sizes) else []
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])
