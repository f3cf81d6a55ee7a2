"""Token ids in binary shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by key.  Each shard is one record of
a table of binary records, so it can be written to any store, with commits that
survive lost executors:

- payload: the ids of its documents one after another, little-endian unsigned
  16-bit integers, each document closed by the end id;
- index: for n keys, a table of displacements and n slots; a key's hash and its
  displacement give its slot, no two keys share one.  A slot has a fingerprint
  of its key (so that other keys are refused), the place of its first id in the
  payload, and its number of ids: a lookup takes the same time whatever the size;
- keys: the documents' keys in payload order, for scans.

Null texts are empty: the end id alone.  Null keys sort first and are kept: a
record says how many it begins with.  Rows that repeat a key are told apart by
their number and may fill several shards; a lookup gives the first.  Very long texts are encoded whole, a shard of their own if need
be.  Only the key and text are read, whatever else the table has.  An empty table
gives an empty store.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, slices, staged
from .textstats import mixed
from .tokenization import PieceEncoder, crc_of

#: Stands for null among the keys of a record; a key of this value is told apart by its place behind the nulls.
NULL_KEY = -(1 << 63)
SLOT = np.dtype([("print", "<u4"), ("offset", "<u4"), ("length", "<u4")])
SCHEMA = "part int, shard int, first_key bigint, last_key bigint, n_null int, n_docs int, n_ids bigint, keys binary, index binary, payload binary"
#: A bucket of keys that has this bit holds its slot instead of a displacement.
DIRECT = np.uint32(1 << 31)


def _hashes(keys: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mixed(keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(number.astype(np.uint64)))


def _slots(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (mixed(h ^ (displacement.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray, number: np.ndarray, offsets: np.ndarray) -> bytes:
    """The index of distinct (key, number) pairs; offsets has one entry more than keys."""
    n = len(keys)
    h = _hashes(keys, number)
    many = max(1, (n + 3) // 4)
    bucket = (h >> np.uint64(32)).astype(np.int64) % many
    order = np.argsort(bucket, kind="stable")
    start = np.searchsorted(bucket[order], np.arange(many + 1))
    size = np.diff(start)
    shift = np.zeros(many, np.uint32)
    owner = np.full(n, -1, np.int64)
    tries = np.arange(256, dtype=np.uint32)
    for b in np.argsort(-size, kind="stable"):
        mine = order[start[b] : start[b + 1]]
        if len(mine) < 2:
            break
        base = 0
        while True:
            at = _slots(h[mine][None, :], (tries + np.uint32(base))[:, None], n)
            fits = (owner[at] < 0).all(1)
            if len(mine) > 1:
                s = np.sort(at, 1)
                fits &= (s[:, 1:] != s[:, :-1]).all(1)
            if fits.any():
                k = int(fits.argmax())
                shift[b] = base + k
                owner[at[k]] = mine
                break
            base += len(tries)
    single = np.flatnonzero(size == 1)
    free = np.flatnonzero(owner < 0)
    shift[single] = free[: len(single)].astype(np.uint32) | DIRECT
    owner[free[: len(single)]] = order[start[single]]
    slots = np.zeros(n, SLOT)
    slots["print"] = (h[owner] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    slots["offset"], slots["length"] = offsets[owner], np.diff(offsets)[owner]
    return np.array([n, many], "<u4").tobytes() + shift.astype("<u4").tobytes() + slots.tobytes()


def find(index: bytes, keys: np.ndarray, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For keys: whether each is in the index (by its fingerprint), its first id's place, its number of ids."""
    n, many = np.frombuffer(index, "<u4", 2).tolist()
    shift = np.frombuffer(index, "<u4", many, 8)
    slots = np.frombuffer(index, SLOT, n, 8 + 4 * many)
    h = _hashes(keys, np.zeros(len(keys), np.int64) if number is None else number)
    d = shift[(h >> np.uint64(32)).astype(np.int64) % many]
    at = np.where(d & DIRECT, (d & ~DIRECT).astype(np.int64) % n, _slots(h, d & ~DIRECT, n))
    hit = slots[at]
    return hit["print"] == (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), hit["offset"].astype(np.int64), hit["length"].astype(np.int64)


def _numbers(keys: np.ndarray) -> np.ndarray:
    """0, 1, ... within runs of equal keys."""
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys))))


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_ids: int = 1 << 20, key: str = "doc_id") -> DataFrame:
    """The store of docs' texts (columns key, text): encoded, sharded and written to the shared folder."""
    encoder = PieceEncoder(tokenizer)
    end = np.array([end_id], "<u2").tobytes()

    def shards(batches):
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def record():
            k = np.array([NULL_KEY if x is None else x for x in keys], np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 2 for x in held])])
            row = [part, shard, int(k[0]), int(k[-1]), keys.count(None), len(k), int(offsets[-1]), k.astype("<i8").tobytes(), build_index(k, _numbers(k), offsets), b"".join(held)]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for piece in slices(batch, "text", 2_000_000):
                for k, ids in zip(piece.column("key").to_pylist(), encoder.encode(piece.column("text").to_pylist()), strict=True):
                    keys.append(k)
                    held.append(ids + end)
                    size += len(ids) // 2 + 1
                    if size >= shard_ids:
                        yield record()
                        keys, held, size, shard = [], [], 0, shard + 1
        if keys:
            yield record()

    # rows equal in key and text can go anywhere among themselves, so that ranges may part them: they are numbered as they come
    named = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64("text").alias("tie"), "text").withColumn("nth", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("key"), F.asc("tie"), F.asc("nth")]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    return staged(map_batches(ranged, shards, SCHEMA), "shards")


def starts(store: DataFrame) -> DataFrame:
    """part, shard and start: the number of ids in the shards before."""
    sizes = staged(store.select("part", "shard", "n_ids"), "sizes")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("base"))  # one row for each partition
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.join(parts, "part").select("part", "shard", (F.col("base") + inside).alias("start"))


def scan(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shards through their indexes."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], "<i8")
                hit, offset, length = find(row["index"], keys, _numbers(keys))
                if not hit.all():
                    raise ValueError("a shard's index doesn't have one of its keys")
                ids = np.frombuffer(row["payload"], "<u2")
                crc = [crc_of(ids[a : a + n]) for a, n in zip(offset.tolist(), length.tolist(), strict=True)]
                null = np.arange(len(keys)) < row["n_null"]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(offset + row["start"]), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = store.join(starts(store), ["part", "shard"]).select("keys", "n_null", "index", "payload", "start")
    return map_batches(rows, read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(store: DataFrame, keys: list[int]) -> DataFrame:
    """key and ids (array<int>) of the keys that the store has; shards that can't have one aren't read.

    A key's shard is found in the directory of first and last keys, its place by
    the shard's index, and the key stored there is compared with it.  Of a key in
    several shards the first counts.
    """
    wanted = np.array(sorted(set(keys)), np.int64)

    def near(batches):
        for batch in batches:
            first, last = (np.searchsorted(wanted, batch.column(c).to_numpy(), side) for c, side in (("first_key", "left"), ("last_key", "right")))
            yield batch.filter(pa.array(first < last))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = wanted[np.searchsorted(wanted, row["first_key"]) : np.searchsorted(wanted, row["last_key"], "right")]
                if len(own):
                    hit, offset, length = find(row["index"], own, np.where(own == NULL_KEY, row["n_null"], 0))
                    hit &= np.isin(own, np.frombuffer(row["keys"], "<i8")[row["n_null"] :])
                    ids = np.frombuffer(row["payload"], "<u2")
                    found = [(int(k), ids[a : a + n].tolist()) for k, a, n, h in zip(own, offset, length, hit, strict=True) if h]
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([row["part"] << 32 | row["shard"]] * len(found), pa.int64())], names=["key", "ids", "at"])

    directory = store.select("part", "shard", "first_key", "last_key")
    places = map_batches(directory, near, directory.schema).select("part", "shard")
    rows = store.join(places, ["part", "shard"], "left_semi").select("part", "shard", "first_key", "last_key", "n_null", "keys", "index", "payload")
    return map_batches(rows, read, "key bigint, ids array<int>, at bigint").groupBy("key").agg(F.min_by("ids", "at").alias("ids"))
