"""Hard negatives by blocked dense products: anchor blocks as files that every task reads, candidate blocks as they are scanned.

A first pass keeps the best rows of an anchor's own label, a second one the best rows of other labels whose score lies in a window
that each of these positives sets. Products are exact: in double precision below 2^53, in whole numbers of any size beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .columns import exact
from .common import fresh_path, put, take, written

#: Bytes of an anchor block and of a candidate block, and rows of each that one product takes.
BLOCK_BYTES, ANCHOR_ROWS, CANDIDATE_ROWS = 32 << 20, 256, 8192
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """vec_id, label, v of the rows that take part; every seventh id carries the next label of ten."""
    vectors = exact(vectors, vec_id=key, label=label, v=vector)
    v = F.col("v").cast("array<double>")
    fits = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x * float(scale)) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"), fits.alias("fits"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("fits"))
    return rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "v")


def matrices(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, tuple]]:
    """(length, (ids, labels, matrix of whole numbers)) of a batch's vectors, for each length that it has."""
    v = batch.column("v")
    offsets, flat = v.offsets.to_numpy(), np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    sizes, ids, labels = np.diff(offsets), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        yield dim, (ids[own], labels[own], flat[offsets[own][:, None] + np.arange(dim)])


def blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[int, tuple]]:
    """The same in blocks of about BLOCK_BYTES, whatever the batches are."""
    held: dict[int, list[tuple]] = {}
    sizes: dict[int, int] = {}

    def joined(dim: int) -> tuple[int, tuple]:
        sizes.pop(dim)
        ids, labels, m = (np.concatenate(x) for x in zip(*held.pop(dim)))
        order = np.argsort(ids, kind="stable")
        return dim, (ids[order], labels[order], m[order])

    for batch in batches:
        for dim, part in matrices(batch, scale):
            held.setdefault(dim, []).append(part)
            sizes[dim] = sizes.get(dim, 0) + 8 * (dim + 2) * len(part[0])
            if sizes[dim] >= BLOCK_BYTES:
                yield joined(dim)
        if sum(sizes.values()) >= 2 * BLOCK_BYTES:  # many lengths
            yield joined(max(sizes, key=sizes.get))
    for dim in list(held):
        yield joined(dim)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where every partial sum is below 2^53, Python's whole numbers otherwise."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).astype(object) @ whole(b).astype(object).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k highest scores above minus infinity, ties to the smaller id; ids are ascending."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        take_ = (scores >= least[:, None]) & (scores > -np.inf)
    else:
        take_ = scores > -np.inf
    row, col = np.nonzero(take_)
    return first(row, ids[col], scores[row, col], k)


def first(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, row)) if scores.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -scores[i], ids[i])), np.int64)
    row, ids, scores = row[order], ids[order], scores[order]
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    keep = place < k
    return row[keep], ids[keep], scores[keep]


def best_of_block(anchors: tuple, candidates: tuple, k: int, masks) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(mask number, anchor row, id, score) of each anchor's k best in a candidate block, for each mask that masks(rows, labels equal, scores) gives."""
    ids, labels, m = anchors
    cids, clabels, cm = candidates
    for a in range(0, len(ids), ANCHOR_ROWS):
        own = slice(a, a + ANCHOR_ROWS)
        found: dict[int, list[tuple]] = {}
        for c in range(0, len(cids), CANDIDATE_ROWS):
            part = slice(c, c + CANDIDATE_ROWS)
            scores = product(m[own], cm[part])
            other = ids[own, None] != cids[None, part]
            for number, keep in masks(own, labels[own, None] == clabels[None, part], scores):
                keep = keep & other
                if keep.any():
                    found.setdefault(number, []).append(best(np.where(keep, scores, -np.inf), cids[part], k))
        for number, parts in found.items():
            row, near, score = (np.concatenate(x) for x in zip(*parts))
            row, near, score = first(row, near, score, k)
            yield number, row + a, near, score


def as_long(scores: np.ndarray) -> pa.Array:
    """Whole scores as longs; one beyond them is given as the nearest."""
    return pa.array(scores.astype(np.int64) if scores.dtype != object else np.array([min(max(int(s), LEAST), MOST) for s in scores], np.int64))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row whose id is divisible by `every`, the
    first `positives` other rows of its label, and for each of them the first `negatives` rows of other labels whose score is
    between low and high hundredths of the positive's.

    A score is the inner product of the components floor(scale * x). Rows with a null id, label or vector, or with a null, non-finite
    or (times scale) overflowing component take no part; vectors meet only those of equal length, empty ones score 0. A score
    beyond a long counts as the nearest long. Repeated rows
    count each, and an anchor never meets a row of its own id; ties go to the smaller id. Fewer rows than asked for give fewer; a
    positive without a negative in its window, and an empty table, give none. Other columns play no part.

    Scale: anchors are dealt into blocks of BLOCK_BYTES, one file each in the shared folder. A candidate is read once a pass; its
    block meets all anchor blocks, one after another, and only the best rows of each anchor and block are shuffled. Work is anchors
    times candidates, as the query asks; memory is two blocks and one product, whatever the sizes.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, label, vector, scale)
    anchors = written(rows.where(F.col("vec_id") % every == 0), "anchors")
    total = anchors.agg(F.sum(8 * (F.size("v") + 2))).first()[0] or 0
    count, folder = max(1, -(-total // BLOCK_BYTES)), fresh_path(spark, "anchor-blocks")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for dim, part in matrices(batch, scale):
                parts.setdefault(dim, []).append(part)
        put(folder, str(TaskContext.get().partitionId()), {dim: tuple(np.concatenate(x) for x in zip(*p)) for dim, p in parts.items()})
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(x[0]) for p in parts.values() for x in p)], pa.int64())})

    anchors.repartition(count).mapInArrow(keep, "n long").agg(F.sum("n")).first()  # dealt in turn, in sorted order, so a task that runs again puts the same

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, candidates in blocks(batches, scale):
            for block in range(count):
                held = take(folder, str(block)).get(dim)
                if held is None:
                    continue
                for _, row, ids, scores in best_of_block(held, candidates, positives, lambda own, same, s: [(0, same)]):
                    yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(row), block), pa.int64()), "dim": pa.array(np.full(len(row), dim), pa.int32()), "row": pa.array(row, pa.int64()), "anchor_id": held[0][row], "positive_id": ids, "positive_score": as_long(scores)})

    found = rows.mapInArrow(near, "block long, dim int, row long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("block", "dim", "row").orderBy(F.desc("positive_score"), "positive_id")
    top = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)

    def keep_positives(table: pa.Table) -> pa.Table:
        put(folder, f"positives-{table.column('block')[0].as_py()}", {name: table.column(name).to_numpy() for name in ("dim", "row", "place", "positive_id", "positive_score")})
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    blocks_with = {r["block"] for r in top.groupBy("block").applyInArrow(lambda t: pa.table({"block": t.column("block").slice(0, keep_positives(t).num_rows)}), "block long").collect()} if total else set()  # a number for each anchor block

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, candidates in blocks(batches, scale):
            for block in sorted(blocks_with):
                held = take(folder, str(block)).get(dim)
                if held is None:
                    continue
                known = take(folder, f"positives-{block}")
                mine = known["dim"] == dim
                ids, scores = np.full((len(held[0]), positives), -1, np.int64), np.full((len(held[0]), positives), -1, np.int64)
                at = known["row"][mine], known["place"][mine] - 1
                ids[at], scores[at] = known["positive_id"][mine], known["positive_score"][mine]
                least, most = windows(scores, low, high)

                def masks(own: slice, same: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
                    for j in range(positives):
                        yield j, ~same & (s >= least[own, j, None]) & (s <= most[own, j, None])

                for j, row, near_ids, near_scores in best_of_block(held, candidates, negatives, masks):
                    yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(row), block), pa.int64()), "dim": pa.array(np.full(len(row), dim), pa.int32()), "row": pa.array(row, pa.int64()), "place": pa.array(np.full(len(row), j), pa.int32()), "anchor_id": held[0][row], "positive_id": ids[row, j], "positive_score": scores[row, j], "negative_id": near_ids, "negative_score": as_long(near_scores)})

    hard = rows.mapInArrow(far, "block long, dim int, row long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("block", "dim", "row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole score between low and high hundredths of each score; no score (-1) and negative ones have an empty window."""
    wide = scores if np.abs(scores).max(initial=0) < 1 << 50 else scores.astype(object)
    return -(-low * wide // 100), high * wide // 100
