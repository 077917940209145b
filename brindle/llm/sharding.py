"""Jump consistent hashing: keys to shards without a ring table.

A key's shard depends on the key and on the number of shards alone. When one
shard is appended, only the keys that it takes move (about 1 in n+1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.common import scratch

#: Multiplier of the published 64-bit linear congruential step.
STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys walk together until none jumps on."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.uint64, copy=True)
    landed = np.zeros(len(state), dtype=np.int64)
    target = np.zeros(len(state), dtype=np.int64)
    alive = np.arange(len(state))
    while len(alive):
        landed[alive] = target[alive]
        state[alive] = state[alive] * STEP + np.uint64(1)
        leap = float(1 << 31) / ((state[alive] >> np.uint64(33)).astype(np.float64) + 1.0)
        target[alive] = ((landed[alive] + 1) * leap).astype(np.int64)
        alive = alive[target[alive] < shards]
    return landed.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a stable key column of any type (null is a key as well).

    The key is mixed by XXH64 in the JVM first, so that runs of consecutive ids
    spread evenly; only those eight bytes a row go to Python.
    """

    @F.pandas_udf("int")
    def jump(mixed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mixed.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return jump(F.xxhash64(key.cast("string")))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 8, grown: bool = True) -> DataFrame:
    """Add ``shard`` (and ``grown_shard``: with one shard more). No shuffle.

    Equal keys get equal shards. Columns of these names are replaced.
    """
    out = df.withColumn("shard", shard_of(F.col(key), shards))
    return out.withColumn("grown_shard", shard_of(F.col(key), shards + 1)) if grown else out


def number_slots(df: DataFrame, order: list[str], buckets: int = 1024) -> DataFrame:
    """Add ``slot``: 0, 1, 2 … in each shard, in any number of tasks.

    Each shard is cut into ``buckets`` by a hash of the ordering columns; rows
    are ranked within a bucket and moved up by the sizes of the buckets before
    it. That table of sizes has at most shards x buckets rows at any input
    size. A null key may hold many equal rows, so its rows are also spread by a
    number of their own. ``df`` must be a materialised table (it is read twice).
    """
    nulls = F.when(F.col(order[0]).isNull(), F.col("_row") % 997).otherwise(F.lit(0))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, nulls), F.lit(buckets)).cast("int"))
    sizes = df.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy(*order, "_row"))
    ranked = df.withColumn("_rank", rank)
    return (
        ranked.join(F.broadcast(starts), ["shard", "_bucket"])
        .withColumn("slot", F.col("_start") + F.col("_rank") - 1)
        .drop("_bucket", "_start", "_rank", "_row")
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard, slot and size of every document by the law ``key``.

    Null text has size 1 and the checksum of the empty string; a null doc_id is
    one more key; repeated rows each get a slot of their own; an empty table
    gives no rows; other columns are not read.
    """
    thin = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = scratch(assign_shards(thin, shards=shards), "shards")
    return number_slots(placed, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
