"""Trees grown level by level from sums: gradient boosting over histograms, and trees of random thresholds.

No task ever holds a class or a node: each level is one aggregate over all rows, keyed by tree, node, feature and bin (or side),
and the driver gets one row for each node. Features may be sparse vectors, dense ones or arrays; what isn't stored is zero.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..sources.scratch import forget, fresh_path, written


# ---- rows and trees ------------------------------------------------------------------------------------


def stored(df: DataFrame, features: str) -> Column:
    """The stored features of a row, an array of (i, x); zeros, nulls and NaNs aren't stored."""
    kind = df.schema[features].dataType
    if isinstance(kind, ArrayType):
        found = F.transform(F.coalesce(features, F.array().cast("array<double>")), lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x")))
    else:
        v = F.unwrap_udt(features)
        found = F.when(v["indices"].isNull(), F.transform(v["values"], lambda x, i: F.struct(i.alias("i"), x.alias("x")))).otherwise(F.arrays_zip(v["indices"].alias("i"), v["values"].alias("x")))
    return F.coalesce(F.filter(found, lambda e: (e["x"] != 0) & ~F.isnan(e["x"])), F.array().cast("array<struct<i:int,x:double>>"))


def entries(df: DataFrame, features: str, *others: str) -> DataFrame:
    """Rows as (index, value) of the stored features, and the other columns."""
    return df.select(stored(df, features).alias("_held"), *others).select(F.col("_held.i").alias("index"), F.col("_held.x").alias("value"), *others)


class Rows:
    """The stored features of a batch as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self._set(batch.column("index"), batch.column("value"))

    @classmethod
    def of(cls, index: pa.ListArray, value: pa.ListArray) -> Rows:
        out = cls.__new__(cls)
        out._set(index, value)
        return out

    def _set(self, index: pa.ListArray, value: pa.ListArray) -> None:
        self.n, self.offsets = len(index), index.offsets.to_numpy() - (index.offsets[0].as_py() if len(index.offsets) else 0)
        self.index, self.value = index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(np.float64)
        self.row = np.repeat(np.arange(self.n), np.diff(self.offsets))

    def columns(self, used: np.ndarray) -> np.ndarray:
        """The features in `used` (ascending) as a dense matrix."""
        out = np.zeros((self.n, len(used)))
        if len(used) and len(self.index):
            top = max(int(self.index.max()), int(used[-1]))
            if top < 1 << 16:
                column = np.full(top + 1, -1)
                column[used] = np.arange(len(used))
                at = column[self.index]
                own = at >= 0
            else:
                at = np.minimum(np.searchsorted(used, self.index), len(used) - 1)
                own = used[at] == self.index
            out[self.row[own], at[own]] = self.value[own]
        return out


@dataclass
class Tree:
    """A node goes left where its feature is at most its threshold; leaves have feature -1. values has a number or a list for each node."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, threshold: float, left, right) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, at, at + 1
        self.feature += [-1, -1]
        self.threshold += [0.0, 0.0]
        self.left += [-1, -1]
        self.right += [-1, -1]
        self.value += [left, right]
        return at, at + 1

    def leaves(self, matrix: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of the used features."""
        node, feature = np.zeros(len(matrix), np.int64), np.array(self.feature)
        at = np.searchsorted(used, feature)
        threshold, left, right = np.array(self.threshold), np.array(self.left), np.array(self.right)
        live = np.flatnonzero(feature[node] >= 0)
        while len(live):
            n = node[live]
            node[live] = np.where(matrix[live, at[n]] <= threshold[n], left[n], right[n])
            live = live[feature[node[live]] >= 0]
        return node


def scored(df: DataFrame, features: str, model, score: Callable, name: str) -> DataFrame:
    """df with prediction and a list of numbers by that name, from score(model, rows)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # trees times nodes

    @F.arrow_udf(f"struct<prediction:double,{name}:array<double>>")
    def run(index: pa.Array, value: pa.Array) -> pa.Array:
        p, all_ = score(shared.value, Rows.of(index, value))
        return pa.StructArray.from_arrays([pa.array(p), pa.array(list(all_), pa.list_(pa.float64()))], names=["prediction", name])

    held = df.withColumn("_held", stored(df, features)).withColumn("_scored", run(F.col("_held.i"), F.col("_held.x")))
    return held.drop("_held").withColumns({"prediction": F.col("_scored.prediction"), name: F.col(f"_scored.{name}")}).drop("_scored")


def used_features(trees: list[Tree]) -> np.ndarray:
    return np.unique(np.array([f for t in trees for f in t.feature if f >= 0], np.int64))


def summed(code: np.ndarray, *amounts: np.ndarray) -> list[np.ndarray]:
    """Codes and, for each, the sum of each amount; codes that lie close together are counted without sorting them."""
    if len(code) and code.min() >= 0 and (top := int(code.max())) < max(1 << 12, 4 * len(code)):
        codes = np.flatnonzero(np.bincount(code))
        return [codes, *(np.bincount(code, x, top + 1)[codes] for x in amounts)]
    codes, back = np.unique(code, return_inverse=True)
    return [codes, *(np.bincount(back, x, len(codes)) for x in amounts)]


def partial(rows: DataFrame, sums: Callable[[pa.RecordBatch], list[np.ndarray]], names: tuple[str, ...]) -> DataFrame:
    """(code, sums) of each task: sums() gives a batch's, which are added up."""
    schema, packs = "code long, " + ", ".join(f"{n} double" for n in names), rows.columns == ["pack"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in unpacked(batches) if packs else batches:
            own = sums(batch)
            held = own if held is None else summed(np.concatenate((held[0], own[0])), *(np.concatenate(x) for x in zip(held[1:], own[1:])))
            if len(held[0]) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["code", *names])
                held = None
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["code", *names])

    return rows.mapInArrow(run, schema)


def aggregated(rows: DataFrame, sums: Callable[[pa.RecordBatch], list[np.ndarray]], names: tuple[str, ...]) -> DataFrame:
    """(code, sums) over all rows."""
    return partial(rows, sums, names).groupBy("code").agg(*(F.sum(n).alias(n) for n in names))


def packed(rows: DataFrame, what: str) -> DataFrame:
    """Rows written as one binary for each batch, which passes hand to Python whole instead of number by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack"])

    path = fresh_path(rows.sparkSession, what)
    # small row groups: a reader holds one of them
    rows.mapInArrow(run, "pack binary").write.option("parquet.block.size", 8 << 20).parquet(path)
    out = rows.sparkSession.read.schema("pack binary").parquet(path)
    out.written_path = path
    return out


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.column("pack"):
            yield from pa.ipc.open_stream(pack.as_buffer())


# ---- boosting ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BoostConfig:
    """loss is softmax, l2, l1 or quantile (of alpha); columns is the share of features that a tree may use; rows' margins are written anew after `refresh` rounds."""

    loss: str = "softmax"
    rounds: int = 50
    rate: float = 0.1
    depth: int = 5
    bins: int = 64
    l2: float = 1.0
    least_rows: int = 20
    alpha: float = 0.5
    columns: float = 1.0
    refresh: int = 10
    seed: int = 42

    def __post_init__(self):
        if self.loss not in ("softmax", "l2", "l1", "quantile"):
            raise ValueError(f"unknown loss {self.loss}")
        if not (0 < self.columns <= 1 and 0 < self.alpha < 1 and 2 <= self.bins <= 256 and min(self.depth, self.least_rows) >= 1):
            raise ValueError("columns and alpha are shares, bins are 2 to 256, depth and rows of a leaf 1 or more")


def bin_edges(rows: DataFrame, bins: int) -> dict[int, np.ndarray]:
    """Ascending upper edges of each feature's bins: quantiles of its stored values, and zero. A feature has at most bins - 1 of them."""
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    x = rows.select(F.inline(F.arrays_zip(F.col("index").alias("feature"), F.col("value").alias("x"))))
    found = x.groupBy("feature").agg(F.percentile_approx("x", shares, 10_000).alias("q")).collect()  # features times bins
    return {r["feature"]: np.unique(np.append(np.array(r["q"], float), 0.0)) for r in found}


def hashed_share(*keys) -> np.ndarray:
    """A share in [0, 1) for each combination of whole numbers, the same wherever it is computed."""
    x = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in keys:
            x = (x ^ np.asarray(k).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(32))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def gradients(loss: str, alpha: float, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives, a column for each tree of a round."""
    if loss == "softmax":
        e = np.exp(margin - margin.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        return p - (y[:, None] == np.arange(margin.shape[1])), np.maximum(p * (1 - p), 1e-16)
    r = margin - y[:, None]
    if loss == "l2":
        return r, np.ones_like(r)
    a = 0.5 if loss == "l1" else alpha
    return np.where(r >= 0, 1 - a, -a), np.ones_like(r)


class Boosted:
    """Trees by round and class, on top of a base margin."""

    def __init__(self, config: BoostConfig, base: np.ndarray, trees: list[list[Tree]] | None = None):
        self.config, self.base, self.trees = config, np.asarray(base, float), trees or []

    def added(self, rows: Rows, since: int = 0) -> np.ndarray:
        """What the rounds since one add to the margins."""
        out = np.zeros((rows.n, len(self.base)))
        used = used_features([t for r in self.trees[since:] for t in r])
        matrix = rows.columns(used)
        for r in self.trees[since:]:
            for k, tree in enumerate(r):
                out[:, k] += np.array(tree.value)[tree.leaves(matrix, used)]
        return out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """df with prediction, the class of the highest margin, ties to the smallest, or the predicted number, and margins."""

        def score(model: Boosted, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
            m = model.base + model.added(rows)
            return (m.argmax(1).astype(float) if model.config.loss == "softmax" else m[:, 0]), m

        return scored(df, features, self, score, "margins")

    def to_json(self) -> str:
        return json.dumps({"config": asdict(self.config), "base": self.base.tolist(), "trees": [[asdict(t) for t in r] for r in self.trees]})

    @staticmethod
    def from_json(text: str) -> Boosted:
        d = json.loads(text)
        return Boosted(BoostConfig(**d["config"]), np.array(d["base"]), [[Tree(**t) for t in r] for r in d["trees"]])


def boost(train: DataFrame, config: BoostConfig, features: str = "features", label: str = "label", weight: str | None = None) -> Boosted:
    """Gradient boosting over histograms.

    Labels are class numbers 0, 1, .. for softmax, numbers otherwise. Rows with a null or NaN label or without weight take no part. A round grows a tree
    for each class at once, level by level: one aggregate of derivatives by (tree, node, feature, bin) over all rows, the best
    split of each node from running sums, ties to the smaller feature and bin. For l1 and quantile losses a leaf's value is
    that quantile of its rows' residuals. Margins are written every `refresh` rounds, so a task applies few trees.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    source = entries(train.withColumns({"_y": F.col(label).cast("double"), "_w": w}).where("_y IS NOT NULL AND NOT isnan(_y) AND _w > 0"), features, "_y", "_w")
    source = source.withColumns({"_margin": F.array().cast("array<double>")})
    state = written(source, "boost-rows")
    edges = bin_edges(state, config.bins)
    known = np.array(sorted(edges), np.int64)
    width = int(known[-1]) + 1 if len(known) else 1
    base = _base(state, config)
    plain, state = state, packed(state, "boost-packs")
    forget(plain)
    model, since, many = Boosted(config, base), 0, len(base)
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((known, [edges[f] for f in known.tolist()]))  # features times bins
    zero = np.zeros(width, np.int64)
    zero[known] = [int(np.searchsorted(edges[f], 0.0)) for f in known.tolist()]

    def prepare(batch: pa.RecordBatch, model: Boosted, start: int) -> tuple[Rows, np.ndarray, np.ndarray, np.ndarray]:
        rows = Rows(batch)
        y, w = batch.column("_y").to_numpy(), batch.column("_w").to_numpy()
        held = batch.column("_margin").flatten().to_numpy()
        return rows, y, w, (held.reshape(rows.n, many) if len(held) else model.base) + model.added(rows, start)

    def binned(rows: Rows) -> np.ndarray:
        known, own = shared.value
        out = np.zeros(len(rows.index), np.int64)
        order = np.argsort(rows.index.astype(np.uint16) if width <= 1 << 16 else rows.index, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(rows.index[order]) != 0))) if len(order) else np.zeros(0, np.int64)
        for a, z in zip(cuts, np.append(cuts, len(order))[1:]):
            at = order[a:z]
            out[at] = np.searchsorted(own[np.searchsorted(known, rows.index[at[0]])], rows.value[at])
        return out

    def histograms(trees: list[Tree], open_: dict[tuple[int, int], tuple], number: int | None) -> tuple[int, Callable]:
        """Nodes of a tree at most, and the function that sums a batch's derivatives by (tree, node, feature, bin); by node alone without a round's number."""
        start, nodes = since, max(len(t.feature) for t in trees)
        before = Boosted(config, base, list(model.trees))
        live = [np.isin(np.arange(nodes), [n for k, n in open_ if k == j]) for j in range(many)]

        def sums(batch: pa.RecordBatch) -> list[np.ndarray]:
            rows, y, w, margin = prepare(batch, before, start)
            g, h = gradients(config.loss, config.alpha, y, margin)
            used = used_features(trees)
            matrix, parts = rows.columns(used), []
            bins = binned(rows) if number is not None else None
            for k, tree in enumerate(trees):
                leaf = tree.leaves(matrix, used)
                on, gw, hw = live[k][leaf], g[:, k] * w, h[:, k] * w
                if number is None:
                    parts.append((k * nodes + leaf[on], gw[on], hw[on], np.ones(int(on.sum()))))
                    continue
                keep = on[rows.row]
                if config.columns < 1:
                    keep = keep & (hashed_share(config.seed, number, k, rows.index) < config.columns)
                at = rows.row[keep]
                parts.append((((k * nodes + leaf[at]) * width + rows.index[keep]) * config.bins + bins[keep], gw[at], hw[at], np.ones(len(at))))
            return summed(*(np.concatenate(x) for x in zip(*parts)))

        return nodes, sums

    def roots(trees: list[Tree]) -> dict[tuple[int, int], tuple]:
        """The sums over all rows, by (tree, 0)."""
        nodes, sums = histograms(trees, dict.fromkeys((k, 0) for k in range(many)), None)
        return {(r["code"] // nodes, 0): (r["g"], r["h"], r["n"]) for r in aggregated(state, sums, ("g", "h", "n")).collect()}

    def level(trees: list[Tree], open_: dict[tuple[int, int], tuple], number: int) -> list:
        """The best split of each open node: (tree, node, feature, bin, left sums)."""
        nodes, sums = histograms(trees, open_, number)
        totals = {k * nodes + n: t for (k, n), t in open_.items()}

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The best split of each node among the features of a partition, from running sums over bins."""
            parts = [[batch.column(i).to_numpy() for i in range(4)] for batch in batches]
            if not sum(len(p[0]) for p in parts):
                return
            code, g, h, n = summed(*(np.concatenate(x) for x in zip(*parts)))
            cell = code // config.bins
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            node, feature = cell[cuts] // width, cell[cuts] % width
            whole = np.array([totals[x] for x in node.tolist()])
            # rows that don't store a feature are in its bin of zero
            rest = [whole[:, i] - np.add.reduceat(x, cuts) for i, x in enumerate((g, h, n))]
            code, g, h, n = summed(np.concatenate((code, cell[cuts] * config.bins + zero[feature])), *(np.concatenate((x, r)) for x, r in zip((g, h, n), rest)))
            cell = code // config.bins
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            size = np.diff(np.append(cuts, len(cell)))
            whole = np.repeat(whole, size, 0)
            gl, hl, nl = (np.cumsum(x) - np.repeat(np.cumsum(x)[cuts] - x[cuts], size) for x in (g, h, n))
            gr, hr, nr = (whole[:, i] - x for i, x in enumerate((gl, hl, nl)))
            gain = np.round(gl * gl / (hl + config.l2) + gr * gr / (hr + config.l2) - whole[:, 0] ** 2 / (whole[:, 1] + config.l2), 9)
            ok = np.flatnonzero((nl >= config.least_rows) & (nr >= config.least_rows) & (gain > 1e-9))
            ok = ok[np.lexsort((code[ok], -gain[ok], cell[ok] // width))]
            owner = cell[ok] // width
            ok = ok[np.concatenate(([True], owner[1:] != owner[:-1]))] if len(ok) else ok
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (code, gain, gl, hl, nl)], names=["code", "gain", "g", "h", "n"])

        dealt = partial(state, sums, ("g", "h", "n")).repartition(F.floor(F.col("code") / config.bins))
        best: dict[int, tuple] = {}
        for r in dealt.mapInArrow(choose, "code long, gain double, g double, h double, n double").collect():  # a row for each open node and partition
            at = r["code"] // config.bins // width
            if at not in best or (-r["gain"], r["code"]) < best[at][0]:
                best[at] = ((-r["gain"], r["code"]), r)
        return [(at // nodes, at % nodes, r["code"] // config.bins % width, r["code"] % config.bins, (r["g"], r["h"], r["n"])) for at, (_, r) in sorted(best.items())]

    def value(g: float, h: float) -> float:
        return -config.rate * g / (h + config.l2)

    def renewed(trees: list[Tree]) -> None:
        """Leaves take the loss's quantile of their rows' residuals."""
        start, before = since, Boosted(config, base, list(model.trees))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in unpacked(batches):
                rows, y, w, margin = prepare(batch, before, start)
                used = used_features(trees)
                yield pa.RecordBatch.from_arrays([pa.array(trees[0].leaves(rows.columns(used), used)), pa.array(y - margin[:, 0])], names=["leaf", "r"])

        a = 0.5 if config.loss == "l1" else config.alpha
        for r in state.mapInArrow(run, "leaf long, r double").groupBy("leaf").agg(F.percentile_approx("r", a, 10_000).alias("q")).collect():  # leaves of one tree
            trees[0].value[r["leaf"]] = config.rate * r["q"]

    for number in range(config.rounds if len(known) else 0):
        trees = [Tree() for _ in range(many)]
        open_ = roots(trees)
        for _ in range(config.depth):
            found, following = level(trees, open_, number), {}
            for k, node, f, b, low in found:
                high = tuple(x - y for x, y in zip(open_[k, node], low))
                left, right = trees[k].split(node, int(f), float(edges[f][b]), value(*low[:2]), value(*high[:2]))
                following |= {(k, left): low, (k, right): high}
            open_ = following
            if not open_:
                break
        if all(len(t.feature) == 1 for t in trees):
            break  # no split helps any more
        if config.loss in ("l1", "quantile"):
            renewed(trees)
        model.trees.append(trees)
        if len(model.trees) - since >= config.refresh and number + 1 < config.rounds:
            start, now = since, Boosted(config, base, list(model.trees))

            def advance(batches: Iterator[pa.RecordBatch], start=start, now=now) -> Iterator[pa.RecordBatch]:
                for batch in unpacked(batches):
                    margin = prepare(batch, now, start)[3]
                    yield batch.set_column(batch.schema.get_field_index("_margin"), "_margin", pa.array(list(margin), pa.list_(pa.float64())))

            last, state = state, packed(state.mapInArrow(advance, plain.schema), "boost-packs")
            forget(last)
            since = len(model.trees)
    forget(state)
    return model


def _base(state: DataFrame, config: BoostConfig) -> np.ndarray:
    if config.loss == "softmax":
        shares = {int(r["_y"]): r["w"] for r in state.groupBy("_y").agg(F.sum("_w").alias("w")).collect()}  # classes
        total = sum(shares.values()) or 1.0
        return np.array([np.log(max(shares.get(k, 0.0) / total, 1e-12)) for k in range(max(shares, default=0) + 1)])
    if config.loss == "l2":
        r = state.agg(F.sum(F.col("_y") * F.col("_w")).alias("s"), F.sum("_w").alias("w")).first()
        return np.array([(r["s"] or 0.0) / (r["w"] or 1.0)])
    a = 0.5 if config.loss == "l1" else config.alpha
    return np.array([state.agg(F.percentile_approx("_y", a, 10_000)).first()[0] or 0.0])


# ---- trees of random thresholds ------------------------------------------------------------------------


@dataclass(frozen=True)
class ExtraConfig:
    """share of the features that a node looks at (None: the root of their number), trees grown at once."""

    trees: int = 100
    depth: int = 10
    least_rows: int = 2
    share: float | None = None
    together: int = 25
    seed: int = 42


class RandomTrees:
    """Trees whose leaves hold class shares; the classes' mean shares are the prediction."""

    def __init__(self, trees: list[Tree], classes: int):
        self.trees, self.classes = trees, classes

    def shares(self, rows: Rows) -> np.ndarray:
        used = used_features(self.trees)
        matrix = rows.columns(used)
        return sum((np.array(t.value)[t.leaves(matrix, used)] for t in self.trees), np.zeros((rows.n, self.classes))) / max(1, len(self.trees))

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """df with prediction, ties to the smaller class, and probability."""

        def score(model: RandomTrees, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
            p = model.shares(rows)
            return np.round(p, 12).argmax(1).astype(float), p

        return scored(df, features, self, score, "probability")


def extra_trees(train: DataFrame, config: ExtraConfig, features: str = "features", label: str = "label", weight: str | None = None) -> RandomTrees:
    """Trees that split each node at one random threshold for each feature it looks at, and take the best of these.

    A level is two aggregates over all rows: the least and greatest value of each (tree, node, feature), between which the threshold is
    drawn by a hash of the three, then each side's class weights. No value is sorted or binned, and a tree depends on seed and rows,
    not on their order or partitioning. Rows with a null label or without weight take no part.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = written(entries(train.withColumns({"_y": F.col(label).cast("double"), "_w": w}).where("_y IS NOT NULL AND NOT isnan(_y) AND _w > 0"), features, "_y", "_w"), "extra-rows")
    most = rows.agg(F.max(F.array_max("index")).alias("f"), F.max("_y").alias("y"), F.count("*").alias("n")).first()
    width, classes = (most["f"] if most["f"] is not None else -1) + 1, int(most["y"] if most["y"] is not None else -1) + 1
    share = config.share if config.share is not None else min(1.0, np.sqrt(max(width, 1)) / max(width, 1))
    spark, out = train.sparkSession, []

    def looks(tree: int, node: np.ndarray, feature: np.ndarray) -> np.ndarray:
        return hashed_share(config.seed, tree, node, feature) < share

    def cells(rows: Rows, trees: list[Tree], first: int, live: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(each row's node or -1, each looked-at entry's place, its cell) tree by tree."""
        used = used_features(trees)
        matrix, nodes = rows.columns(used), len(live[0])
        for t, tree in enumerate(trees):
            leaf = tree.leaves(matrix, used)
            node = np.where(live[t][leaf], leaf, -1)
            at = np.flatnonzero(node[rows.row] >= 0)
            at = at[looks(first + t, node[rows.row[at]], rows.index[at])]
            yield np.where(node >= 0, t * nodes + node, -1), at, (t * nodes + node[rows.row[at]]) * width + rows.index[at]

    def spans(trees: list[Tree], first: int, live: list[np.ndarray]) -> dict[int, tuple[float, float, float]]:
        """By cell: least and greatest stored value, and rows that store one."""

        def merged(code, low, high, n):
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0))) if len(code) else np.zeros(0, np.int64)
            if not len(code):
                return code, low, high, n
            return code[order][cuts], np.minimum.reduceat(low[order], cuts), np.maximum.reduceat(high[order], cuts), np.add.reduceat(n[order], cuts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                r = Rows(batch)
                for _, at, cell in cells(r, trees, first, live):
                    own = merged(cell, r.value[at], r.value[at], np.ones(len(at)))
                    held = own if held is None else merged(*(np.concatenate(x) for x in zip(held, own)))
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["code", "low", "high", "n"])

        found = rows.mapInArrow(run, "code long, low double, high double, n double").groupBy("code").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()  # trees times nodes times looked-at features
        return {r["code"]: (r["low"], r["high"], r["n"]) for r in found}

    def sides(trees: list[Tree], first: int, live: list[np.ndarray], cut: tuple[np.ndarray, np.ndarray]) -> dict[int, np.ndarray]:
        """Weights of each class: by -1 - node for whole nodes, by cell for the stored values at most the cell's threshold, and by cells + cell for all stored ones."""
        shared, total = spark.sparkContext.broadcast(cut), len(trees) * len(live[0]) * width

        def sums(batch: pa.RecordBatch) -> list[np.ndarray]:
            r, y, w = Rows(batch), batch.column("_y").to_numpy().astype(np.int64), batch.column("_w").to_numpy()
            known, threshold = shared.value
            parts = []
            for node, at, cell in cells(r, trees, first, live):
                on = np.flatnonzero(node >= 0)
                parts.append(((-1 - node[on]) * classes + y[on], w[on], np.ones(len(on))))
                place = np.minimum(np.searchsorted(known, cell), max(len(known) - 1, 0))
                has = known[place] == cell if len(known) else np.zeros(len(cell), bool)
                at, cell, place = at[has], cell[has], place[has]
                low = r.value[at] <= threshold[place]
                for keep, base in ((low, 0), (np.ones(len(at), bool), total)):
                    x = r.row[at[keep]]
                    parts.append(((base + cell[keep]) * classes + y[x], w[x], np.ones(len(x))))
            return summed(*(np.concatenate(x) for x in zip(*parts)))

        found: dict[int, np.ndarray] = {}
        for r in aggregated(rows, sums, ("w", "n")).collect():
            found.setdefault(r["code"] // classes, np.zeros((2, classes)))[:, r["code"] % classes] = r["w"], r["n"]
        return found

    def gini(w: np.ndarray) -> float:
        total = w.sum()
        return float(total - (w * w).sum() / total) if total > 0 else 0.0

    for first in range(0, config.trees if width and classes else 0, config.together):
        trees = [Tree(value=[[0.0] * classes]) for _ in range(min(config.together, config.trees - first))]
        open_, sizes = {(t, 0) for t in range(len(trees))}, {(t, 0): most["n"] for t in range(len(trees))}
        for depth in range(config.depth + 1):
            nodes = max(len(t.feature) for t in trees)
            live = [np.isin(np.arange(nodes), [n for k, n in open_ if k == t]) for t in range(len(trees))]
            span = spans(trees, first, live) if depth < config.depth else {}
            counted = {c: s[2] for c, s in span.items()}
            code = np.array(sorted(span), np.int64)
            low, high = (np.array([span[c][i] for c in code.tolist()]) for i in (0, 1))
            tree, node, feature = code // (nodes * width), code // width % nodes, code % width
            # rows that don't store the feature hold zero
            zeros = np.array([sizes[c // width // nodes, c // width % nodes] > counted[c] for c in code.tolist()], bool)
            low, high = np.where(zeros, np.minimum(low, 0), low), np.where(zeros, np.maximum(high, 0), high)
            threshold = low + (high - low) * hashed_share(config.seed + 1, first + tree, node, feature)
            keep = low < high
            code, threshold = code[keep], threshold[keep]
            found = sides(trees, first, live, (code, threshold))
            total = len(trees) * nodes * width
            best: dict[int, tuple] = {}
            for c, cut in zip(code.tolist(), threshold.tolist()):
                whole, stored, left = (found.get(k, np.zeros((2, classes))) for k in (-1 - c // width, total + c, c))
                if cut >= 0:
                    left = left + whole - stored
                right = whole - left
                if min(left[1].sum(), right[1].sum()) < config.least_rows:
                    continue
                gain = round(gini(whole[0]) - gini(left[0]) - gini(right[0]), 9)
                if gain > 0 and (gain, -c) > best.get(c // width, ((0.0, 0),))[0]:
                    best[c // width] = ((gain, -c), c % width, cut, left[1].sum(), right[1].sum())
            for t, n in sorted(open_):
                w = found.get(-1 - (t * nodes + n), np.zeros((2, classes)))[0]
                trees[t].value[n] = (w / w.sum() if w.sum() > 0 else w).tolist()
            open_ = set()
            for at, (_, f, cut, low_n, high_n) in sorted(best.items()):
                t = at // nodes
                a, b = trees[t].split(at % nodes, f, cut, [0.0] * classes, [0.0] * classes)
                open_ |= {(t, a), (t, b)}
                sizes |= {(t, a): low_n, (t, b): high_n}
            if not open_:
                break
        out += trees
    forget(rows)
    return RandomTrees(out, classes)
