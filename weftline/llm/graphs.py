"""Connected components and set filters that no driver or single task has to hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, trim, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b) of longs: the smallest node of its connected component, for each node but that one itself.

    Alternating large-star and small-star: rounds grow with the logarithm of a component's width. Minima are aggregated
    before the shuffle and joined back, so the edges of a hub are split by the join's skew handling. Each round is a
    written table; rounds go on until one changes nothing.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lows, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()
        last, current = current, written(small.where("u <> v"), "edges")
        forget(last)
    return current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


#: Bits of a filter that one row holds on the way to the driver.
BLOCK_BITS = 1 << 21


def bloom(keys: DataFrame, column: str, most_bits: int = 1 << 26) -> tuple[np.ndarray, int]:
    """A Bloom filter (bytes, bits) of a long column, of 16 bits a key and most_bits at most; beyond, it only lets more through.

    Each task makes its own, and they are put together block by block on the executors; the driver gets the blocks, 8 MB at most.
    """
    n = keys.count()
    bits = 1 << int(np.clip(np.ceil(np.log2(16 * max(n, 64))), 10, np.log2(most_bits)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0), bits):
                np.bitwise_or.at(own, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        for i, a in enumerate(range(0, bits // 8, BLOCK_BITS // 8)):
            block = own[a : a + BLOCK_BITS // 8]
            if block.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int64()), "bitmap": pa.array([block.tobytes()], pa.binary())})
        del own
        trim()

    def merge(rows: pa.Table) -> pa.Table:
        out = np.frombuffer(rows.column("bitmap")[0].as_buffer(), np.uint8).copy()
        for x in rows.column("bitmap").slice(1):
            out |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"block": rows.column("block").slice(0, 1), "bitmap": pa.array([out.tobytes()], pa.binary())})

    parts = keys.select(F.col(column).cast("long")).mapInArrow(fill, "block long, bitmap binary").groupBy("block").applyInArrow(merge, "block long, bitmap binary").collect()  # most_bits / 8 bytes at most
    out = np.zeros(bits // 8, np.uint8)
    for p in parts:
        at = p["block"] * (BLOCK_BITS // 8)
        out[at : at + len(p["bitmap"])] = np.frombuffer(p["bitmap"], np.uint8)
    return out, bits


def bloom_has(bitmap: np.ndarray, bits: int, keys: pa.Array) -> np.ndarray:
    """Which keys the filter lets through."""
    keep = np.ones(len(keys), bool)
    for place in _places(keys, bits):
        keep &= (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
    return keep


def _places(column: pa.Array, bits: int) -> list[np.ndarray]:
    x = column.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    out = []
    for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        y = (x ^ (x >> np.uint64(31))) * np.uint64(k)
        y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((y >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64))
    return out


def maybe_in(rows: DataFrame, column: str, keys: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """The rows whose key may be (inside) or surely isn't (not inside) among the keys: a bounded filter before a shuffle, not a join. Only keys reach Python."""
    spark = rows.sparkSession
    words, bits = bloom(keys, key)
    shared = spark.sparkContext.broadcast(words)  # 8 MB at most

    @F.arrow_udf("boolean")
    def kept(x: pa.Array) -> pa.Array:
        keep = bloom_has(shared.value, bits, x)
        return pa.array(keep if inside else ~keep)

    return rows.where(kept(F.col(column)))
