"""Sentence vectors from token vectors: the mean over the tokens that a mask keeps, of ragged rows held as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash32
from ..sources.scratch import fresh_path, put, take


def mean_pooled(flat: Column, mask: Column, width: int, most: int = 256) -> Column:
    """The mean of a row's token vectors whose mask isn't zero, among the first `most` ones.

    flat has the vectors one after another, mask a number for each. Rows without a kept token, and null ones, give zeros; a flat array that
    doesn't hold `width` numbers for each entry of the mask is an error. A batch is pooled in one pass over its numbers.
    """

    @F.arrow_udf("array<double>")
    def run(flat: pa.Array, mask: pa.Array) -> pa.Array:
        return pooled(flat, mask, width, most)

    return run(flat, mask)


def pooled(flat: pa.ListArray, mask: pa.ListArray, width: int, most: int) -> pa.Array:
    n = len(flat)
    sizes = [np.diff(a.offsets.to_numpy()) * ~np.asarray(a.is_null()) for a in (flat, mask)]
    if (sizes[0] != width * sizes[1]).any():
        raise ValueError(f"a row holds {width} numbers for each of its tokens")
    values, keep = (a.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for a in (flat, mask))
    row = np.repeat(np.arange(n), sizes[1])
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes[1]) - sizes[1], sizes[1])
    used = np.flatnonzero((np.nan_to_num(keep) != 0) & (place < most))
    total = np.zeros((n, width))
    if len(used):
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(row[used]) != 0)))
        total[row[used[cuts]]] = np.add.reduceat(values.reshape(-1, width)[used], cuts)
    out = total / np.maximum(np.bincount(row[used], minlength=n), 1)[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(out.ravel()))


#: A file of vectors holds about so many bytes.
BLOCK_BYTES = 32 << 20
#: Tokens that are pooled together, and how many of their vectors are held at once.
TOKENS, HELD = 1 << 22, 1 << 14


def encoded(df: DataFrame, key: str, text: str, vectors: DataFrame, vec_id: str, vector: str, width: int, most: int = 256) -> DataFrame:
    """(key, tokens, encoding): each text's first `most` words, each word by the vector that its hash points to, pooled; single characters are masked.

    Vectors may be as many as they like: ranges of their ids are files of BLOCK_BYTES in the shared folder, which a task reads one after another
    for all its tokens, so neither texts nor vectors are shuffled per token. Keys are unique; null and empty texts, and words without a vector, have none.
    """
    spark = df.sparkSession
    count = vectors.count()
    blocks, folder = max(1, -(-count * width * 8 // BLOCK_BYTES)), fresh_path(spark, "vector-blocks")
    own = vectors.select(F.col(vec_id).cast("long").alias("vec"), F.col(vector).alias("v")).where((F.col("vec") >= 0) & (F.col("vec") < count))

    def keep(block: tuple, table: pa.Table) -> pa.Table:
        put(folder, str(block[0].as_py()), table.sort_by("vec"))
        return pa.table({"block": [block[0].as_py()]}, pa.schema([("block", pa.int64())]))

    known = sorted(r[0] for r in own.groupBy(F.floor(F.col("vec") * blocks / max(count, 1)).alias("block")).applyInArrow(keep, "block long").collect()) if count else []  # a number for each file
    words = F.slice(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != ""), 1, most)
    tokens = df.select(F.col(key), words.alias("_words")).select(key, F.transform("_words", lambda w: hash32(w) % max(count, 1)).alias("_vec"), F.transform("_words", lambda w: F.length(w) > 1).alias("_mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]

        def block(number: int) -> pa.Table:
            if last[0] != number:
                last[:] = number, take(folder, str(number))
            return last[1]

        for part in packs(batches):
            yield from pooled_words(part, key, (block(b) for b in known), width)

    kind = df.schema[key].dataType.simpleString()
    return tokens.mapInArrow(run, f"`{key}` {kind}, tokens int, encoding array<double>")


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut and put together to about TOKENS tokens each."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            held.append(batch.slice(at, 4096))
            size += len(held[-1].column("_vec").flatten())
            if size >= TOKENS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pooled_words(batch: pa.RecordBatch, key: str, blocks: Iterator[pa.Table], width: int) -> Iterator[pa.RecordBatch]:
    n, vec = batch.num_rows, batch.column("_vec").flatten().to_numpy()
    mask = batch.column("_mask").flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), np.diff(batch.column("_vec").offsets.to_numpy()))
    total, tokens, kept = np.zeros((n, width)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for table in blocks if len(vec) else ():
        ids, v = table.column("vec").to_numpy(), table.column("v").combine_chunks()
        v = v if isinstance(v, pa.Array) else v.chunk(0)
        there = ~np.asarray(v.is_null())
        if (np.diff(v.offsets.to_numpy())[there] != width).any():
            raise ValueError(f"a vector holds {width} numbers")
        values, place = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), np.cumsum(there) - 1
        low, high = np.searchsorted(ids, vec), np.searchsorted(ids, vec, "right")
        times = high - low
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())  # an id may have several vectors
        mine = np.repeat(row, times)
        tokens += np.bincount(mine, minlength=n)
        used = np.repeat(mask, times) & there[at]
        at, mine = place[at[used]], mine[used]
        kept += np.bincount(mine, minlength=n)
        for a in range(0, len(at), HELD):
            rows, parts = mine[a : a + HELD], values[at[a : a + HELD]].astype(np.float64)
            cuts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            total[rows[cuts]] += np.add.reduceat(parts, cuts)
    total /= np.maximum(kept, 1)[:, None]
    encoding = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(total.ravel()))
    out = pa.RecordBatch.from_arrays([batch.column(key), pa.array(tokens, pa.int32()), encoding], names=[key, "tokens", "encoding"])
    for a in range(0, n, 4096):
        yield out.slice(a, 4096)
