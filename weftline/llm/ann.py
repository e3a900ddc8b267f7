"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, kept as flat neighbour arrays.

Vectors fall into cells by their nearest centroid, cells of many vectors into several shards; a query visits the shards of its
nearest cells, of all cells unless told otherwise, and their results are merged. Each graph is a file in the shared folder that searching tasks read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import fresh_path, only, put, take, written

#: Links of a node above the ground level (twice as many there), candidates kept while building and searching, vectors of a shard, queries of a block.
LINKS, BUILD_WIDTH, SEARCH_WIDTH, SHARD, BLOCK = 16, 64, 96, 16_384, 1024
#: Cells at most, vectors that centroids are fitted on at most (those of the smallest hashes), vector lengths that get centroids.
CELLS, FITTED, LENGTHS = 1024, 32_768, 64
#: Nodes inserted at once, and candidates expanded at once.
BATCH, EXPAND = 256, 4


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities), nearest first and -1 padded, of a best-first search for all queries at once."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(vectors) + 1), bool)  # the last column takes padding
    ids = np.full((n, width), -1, np.int64)
    sims = np.full((n, width), -np.inf, np.float32)
    entries = entries[:, :width]
    ids[:, : entries.shape[1]] = entries
    sims[:, : entries.shape[1]] = np.where(entries >= 0, np.einsum("qed,qd->qe", vectors[entries], queries), -np.inf)
    seen[rows, ids] = True
    fresh = ids >= 0
    live = np.arange(n)
    while len(live):
        open_ = np.where(fresh[live], sims[live], -np.inf)
        pick = np.argpartition(-open_, EXPAND, axis=1)[:, :EXPAND] if width > EXPAND else np.argsort(-open_, axis=1)
        ok = np.take_along_axis(open_, pick, 1) > -np.inf
        going = ok.any(1)
        live, pick, ok = live[going], pick[going], ok[going]
        if not len(live):
            break
        at = live[:, None]
        fresh[at, pick] = False
        near = np.where(ok[:, :, None], links[ids[at, pick]], -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[at, near]] = -1
        seen[at, near] = True
        s = np.where(near >= 0, np.einsum("qed,qd->qe", vectors[near], queries[live]), -np.inf).astype(np.float32)
        all_ids, all_sims = np.concatenate((ids[live], near), 1), np.concatenate((sims[live], s), 1)
        all_fresh = np.concatenate((fresh[live], near >= 0), 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live], sims[live], fresh[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_fresh))
        fresh[live] &= sims[live] > -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.where(np.take_along_axis(sims, order, 1) > -np.inf, np.take_along_axis(ids, order, 1), -1), np.take_along_axis(sims, order, 1)


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` links per row, nearest first, each nearer to the row's node than to the links before it; then the nearest left over."""
    n, width = ids.shape
    between = np.einsum("qed,qfd->qef", vectors[ids], vectors[ids])
    out = np.full((n, most), -1, np.int64)
    rows, valid = np.arange(n), ids >= 0
    free = valid.copy()
    used = np.zeros_like(valid)
    for k in range(most):
        score = np.where(free, sims, -np.inf)
        best = score.argmax(1)
        ok = score[rows, best] > -np.inf
        if not ok.all():  # nothing diverse is left: the nearest that isn't used
            score2 = np.where(valid & ~used, sims, -np.inf)
            best = np.where(ok, best, score2.argmax(1))
            ok2 = ok | (score2[rows, best] > -np.inf)
        else:
            ok2 = ok
        out[:, k] = np.where(ok2, ids[rows, best], -1)
        used[rows, best] |= ok2
        free &= ~(between[rows, best] > sims) | ~ok[:, None]
        free[rows, best] = False
    return out


def build_level(vectors: np.ndarray, nodes: np.ndarray, most: int, enter) -> np.ndarray:
    """Neighbour array (len(vectors) x most, -1 padded) over `nodes`, inserted in batches; enter(queries) gives entry points."""
    links = np.full((len(vectors) + 1, most), -1, np.int64)
    placed = nodes[:0]
    for a in range(0, len(nodes), BATCH):
        batch = nodes[a : a + BATCH]
        q = vectors[batch]
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        near = np.argsort(-inner, axis=1)[:, : min(most, len(batch) - 1)]
        ids, sims = batch[near], np.take_along_axis(inner, near, 1)
        if len(placed):
            entries = enter(q)
            start = np.zeros(len(vectors) + 1, bool)
            start[placed] = True
            entries = np.where(start[entries], entries, -1)
            entries = np.concatenate((entries, np.broadcast_to(placed[:: max(1, len(placed) // 4)][:4], (len(q), min(4, len(placed))))), 1)
            entries.sort(axis=1)
            entries[:, 1:][entries[:, 1:] == entries[:, :-1]] = -1
            found, s = beam(vectors, links, q, entries, BUILD_WIDTH)
            ids, sims = np.concatenate((ids, found), 1), np.concatenate((sims, s), 1)
        if ids.shape[1] == 0:
            placed = np.concatenate((placed, batch))
            continue
        chosen = diverse(vectors, ids, sims, max(1, most // 2))
        links[batch, : chosen.shape[1]] = chosen
        # backward links; a full list is chosen anew among its own and the new ones
        src, dst = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        heads, first, count = np.unique(dst, return_index=True, return_counts=True)
        wide = np.full((len(heads), most + int(count.max(initial=0))), -1, np.int64)
        wide[:, :most] = links[heads]
        wide[np.repeat(np.arange(len(heads)), count), most + np.arange(len(dst)) - np.repeat(first, count)] = src
        wide.sort(axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        wide = -np.sort(-wide, axis=1)  # padding last
        fits = (wide >= 0).sum(1) <= most
        links[heads[fits]] = wide[fits, :most]
        if not fits.all():
            w, h = wide[~fits], heads[~fits]
            w = w[:, : int((w >= 0).sum(1).max())]
            s = np.where(w >= 0, np.einsum("qed,qd->qe", vectors[w], vectors[h]), -np.inf)
            links[h] = diverse(vectors, w, s, most)
        placed = np.concatenate((placed, batch))
    return links


class Graph:
    """levels[i]: neighbour array of level i; nodes of a level are those whose drawn height reaches it."""

    def __init__(self, unit: np.ndarray, levels: list[np.ndarray], top: np.ndarray):
        self.unit, self.levels, self.top = unit, levels, top

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 0) -> Graph:
        unit = np.vstack((unit, np.zeros((1, unit.shape[1]), unit.dtype))).astype(np.float32)  # row -1 is padding
        n = len(unit) - 1
        height = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 12)
        tops = [np.flatnonzero(height >= level) for level in range(int(height.max(initial=0)) + 1)]
        while len(tops) > 1 and len(tops[-1]) < 4:
            tops.pop()
        graph = cls(unit, [], tops[-1][:32])
        built: list[np.ndarray] = []
        for level in range(len(tops) - 1, -1, -1):
            graph.levels = built
            built = [build_level(unit[:-1], tops[level], 2 * LINKS if level == 0 else LINKS, graph._enter), *built]
        graph.levels = built
        return graph

    def _enter(self, queries: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.top[:8], (len(queries), min(8, len(self.top)))).copy()
        for links in reversed(self.levels):
            at = beam(self.unit[:-1], links, queries, at, 8)[0]
        return at

    def search(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        at = np.broadcast_to(self.top[:8], (len(queries), min(8, len(self.top)))).copy()
        for links in reversed(self.levels[1:]):
            at = beam(self.unit[:-1], links, queries, at, 8)[0]
        return beam(self.unit[:-1], self.levels[0], queries, at, width)[0]

    def pack(self) -> list[bytes]:
        return [x[:-1].astype(np.int32).tobytes() for x in self.levels]

    @classmethod
    def unpack(cls, unit: np.ndarray, levels: list[bytes], top: np.ndarray) -> Graph:
        unit = np.vstack((unit, np.zeros((1, unit.shape[1]), unit.dtype))).astype(np.float32)
        n = len(unit) - 1
        arrays = [np.vstack((a := np.frombuffer(x, np.int32).reshape(n, -1), np.full((1, a.shape[1]), -1, np.int32))).astype(np.int64) for x in levels]
        return cls(unit, arrays, top)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): array<double> rows that can take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 as 0.0
    clean = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL").where(clean)


def scaled(rows: DataFrame) -> DataFrame:
    """Vectors by the power of two that brings their largest component to [1/2, 1): no square overflows or vanishes, and no cosine changes by a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
            if len(flat):
                most = np.maximum.reduceat(np.abs(flat), np.cumsum(sizes) - sizes)
                flat = np.ldexp(flat, -np.repeat(np.frexp(most)[1], sizes)) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))], names=["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v array<double>")


def centroids(unit: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """k directions at most, by k-means on the sphere."""
    random = np.random.default_rng(seed)
    c = unit[random.choice(len(unit), min(k, len(unit)), replace=False)].astype(np.float32)
    for _ in range(rounds if len(c) > 1 else 0):
        own = np.concatenate([(unit[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(unit), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, unit)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c)
    return c


def _quantizer(nodes: DataFrame, shard_size: int) -> dict[int, np.ndarray]:
    """Centroids by vector length: of the most frequent LENGTHS ones, fitted on FITTED vectors in all; other lengths are one cell."""
    counts = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    sample = nodes.orderBy(F.xxhash64("v"), F.element_at("ids", 1)).limit(FITTED).select("dim", "v").toArrow()  # FITTED rows at most
    dims, vectors, out = sample.column("dim").to_numpy(), sample.column("v").combine_chunks(), {}
    for row in counts:
        own = vectors.filter(pa.array(dims == row["dim"]))
        k = min(CELLS, -(-row["count"] // shard_size), len(own) // 16)
        if k > 1:
            v = own.flatten().to_numpy().reshape(len(own), -1)
            out[row["dim"]] = centroids((v / _norm(v)[:, None]).astype(np.float32), k)
    return out


def _cells(rows: DataFrame, quantizer: dict[int, np.ndarray], most: int) -> DataFrame:
    """The rows with `cells`, the `most` nearest cells of v."""
    shared = rows.sparkSession.sparkContext.broadcast(quantizer)  # CELLS centroids of each of LENGTHS lengths at most
    at, names = rows.columns.index("v"), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, cells = batch.column(at), [[0]] * batch.num_rows
            sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim, c in shared.value.items():
                own = np.flatnonzero(sizes == dim)
                for a in range(0, len(own), 1024):
                    x = flat[starts[own[a : a + 1024], None] + np.arange(dim)].astype(np.float32)
                    near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :most]
                    for i, found in zip(own[a : a + 1024].tolist(), near.tolist()):
                        cells[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*names, "cells"])

    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in rows.dtypes) + ", cells array<long>")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_size: int = SHARD, probes: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows by cosine, ties to the smaller id.

    Null, zero and non-finite vectors and null ids take no part; vectors meet only those of equal length; an id's repeated rows are
    candidates once per distinct vector, never for a query of their own id; fewer than k candidates give fewer rows; empty tables give none;
    other columns play no part. Scores are computed in double precision from the original vectors, scaled by powers of two, which changes no
    bit of them and keeps very large and very small components from overflowing or vanishing.

    Scale: vectors that are equal up to a power of two are one node with its k + 1 smallest ids (cut to these on the map side, so a very common vector neither
    gathers nor bends the graph). Nodes fall into cells, cells into shards of about shard_size; a shard's graph is one file of flat
    arrays in the shared folder, which tasks read by its name. A query visits the shards of its `probes` nearest cells, in blocks, and
    only k nodes a query and shard come back. By default these are all cells, so search grows with queries times shards: where vectors
    don't form clusters, fewer cells lose neighbours whatever the graphs do. Fewer are for clustered vectors only.
    """
    spark = vectors.sparkSession
    rows = written(scaled(usable(vectors, key, vector)).distinct(), "vectors")
    members = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    nodes = written(members.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v")), "nodes")
    quantizer = _quantizer(nodes, shard_size)
    placed = written(_cells(nodes, quantizer, 1).select("dim", F.col("cells")[0].alias("cell"), "v", "ids"), "placed")
    shards = placed.groupBy("dim", "cell").count().select("dim", "cell", F.ceil(F.col("count") / shard_size).alias("shards"))
    # LENGTHS * CELLS cells of lengths with centroids, and one cell for each other length: joined without a hint
    dealt = placed.join(shards, ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64(F.element_at("ids", 1), "v"), "shards"))
    folder = fresh_path(spark, "graphs")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(first=[x[0] for x in frame["ids"]]).sort_values("first")
        v = np.array(frame["v"].tolist(), np.float64)
        graph = Graph.build(v / _norm(v)[:, None])
        name = "-".join(str(int(frame[x].iloc[0])) for x in ("dim", "cell", "shard"))
        put(folder, name, {"vectors": v, "ids": [list(map(int, x)) for x in frame["ids"]], "levels": graph.pack(), "top": graph.top})
        return pd.DataFrame({"dim": frame["dim"].iloc[:1], "cell": frame["cell"].iloc[:1], "shard": frame["shard"].iloc[:1]})

    index = written(dealt.groupBy("dim", "cell", "shard").applyInPandas(build, "dim int, cell long, shard long"), "index")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"))
    blocks = max(1, -(-asked.count() // BLOCK))
    visits = _cells(asked, quantizer, probes).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("cell", F.explode("cells")).drop("cells").join(index, ["dim", "cell"])

    def load(name: str) -> tuple:
        held = take(folder, name)
        v = held["vectors"]
        norms = _norm(v)
        return Graph.unpack(v / norms[:, None], held["levels"], held["top"]), v, norms, held["ids"]

    def search(queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        name, q = "-".join(str(int(queries[x].iloc[0])) for x in ("dim", "cell", "shard")), np.array(queries["v"].tolist(), np.float64)
        graph, v, norms, ids = only(("graph", folder, name), lambda: load(name))
        for a in range(0, len(q), BATCH):
            part = q[a : a + BATCH]
            found = graph.search((part / _norm(part)[:, None]).astype(np.float32))[:, : 4 * (k + 1)]
            for i, near in enumerate(found):
                near = near[near >= 0]
                scores = (v[near] @ part[i]) / (norms[near] * _norm(part[i : i + 1])[0])
                own = int(queries["query_id"].iloc[a + i])
                hits = [(own, int(x), float(s)) for n, s in zip(near, scores) for x in ids[n] if int(x) != own]
                out += sorted(hits, key=lambda h: (-h[2], h[1]))[:k]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = visits.groupBy("dim", "cell", "shard", "block").applyInPandas(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _norm(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))
