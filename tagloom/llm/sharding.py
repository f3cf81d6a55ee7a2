"""Placement of keys on shards by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime
size (an offset and a step, both from a digest of its name).  Shards take turns;
in its turn a shard claims the first free slot of its order.  The table is
filled once, holds table_size entries whatever the data size, and is broadcast,
so that a key is placed by one hash and one lookup.  When a shard is added or
removed, few slots change hands.

Null keys are placed as the empty string, repeated rows each (equal keys have one
shard); texts aren't read, whatever their length.  Shards of one name are refused,
as they would claim the same slots.  An empty table stays empty.  Columns of the
input pass through; the two new columns replace columns of those names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the operator: hexadecimal digits of the key's MD5 digest that are read.
DIGITS = 15


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], table_size: int = 65537) -> list[int]:
    """The shard (as its place in shards) that owns each slot."""
    if not is_prime(table_size) or not 0 < len(shards) <= table_size:
        raise ValueError("table_size must be prime and at least the number of shards")
    if len(set(shards)) < len(shards):
        raise ValueError("two shards have one name")
    digest = lambda kind, name: int(hashlib.md5(f"{kind}:{name}".encode()).hexdigest(), 16)
    place = [digest("offset", s) % table_size for s in shards]
    step = [digest("step", s) % (table_size - 1) + 1 for s in shards]
    owner, left = [-1] * table_size, table_size
    while left:
        for shard in range(len(shards)):
            at = place[shard]
            while owner[at] >= 0:
                at = (at + step[shard]) % table_size
            owner[at] = shard
            place[shard] = (at + step[shard]) % table_size
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, table_size: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint") % F.lit(table_size)


def place(df: DataFrame, key: str, shards: list[str], table_size: int = 65537, spread_hot: float | None = None, spread_by: str | None = None) -> DataFrame:
    """df with columns slot (long) and shard (string).

    spread_hot: keys with more than this share of the rows are dealt over all
    slots by the key together with spread_by, as one shard couldn't hold them.
    There are at most 1/spread_hot such keys, so their list is broadcast.
    """
    spark = df.sparkSession
    owner = lookup_table(shards, table_size)
    table = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("pos", "owner"))
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    table = table.select(F.col("pos").cast("bigint").alias("__slot"), F.get(names, F.col("owner").cast("int")).alias("__shard"))
    keyed = F.col(f"`{key}`")
    if spread_hot:
        if not spread_by:
            raise ValueError("spread_hot needs spread_by")
        total = df.count()
        hot = df.groupBy(keyed.cast("string").alias("__key")).count().where(F.col("count") > spread_hot * total).select("__key", F.lit(True).alias("__hot"))
        df = df.join(F.broadcast(hot), keyed.cast("string").eqNullSafe(F.col("__key")), "left").drop("__key")
        text = F.when(F.col("__hot"), F.concat_ws("\x1f", keyed.cast("string"), F.col(f"`{spread_by}`").cast("string"))).otherwise(keyed.cast("string"))
        df = df.withColumn("__slot", slot_of(text, table_size)).drop("__hot")
    else:
        df = df.withColumn("__slot", slot_of(keyed, table_size))
    out = df.join(F.broadcast(table), "__slot", "left")
    return out.drop("slot", "shard").withColumnsRenamed({"__slot": "slot", "__shard": "shard"})
