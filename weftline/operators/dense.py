"""A dense head, trained by tasks that run side by side and average their gradients at every step.

Normalized inputs, two hidden layers with smooth rectifiers and dropout, cross-entropy or smooth absolute error, decoupled weight
decay. The tasks of a barrier stage each hold a share of the rows and the same coefficients; what they exchange is one gradient a step.
After each epoch the state is kept in a shared folder, where a stage that runs again after a lost task, or a later call, goes on.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir
from .trees import Rows, entries, hashed_share, scored

NAMES = ("scale", "shift", "w1", "b1", "w2", "b2", "w3", "b3")


@dataclass(frozen=True)
class DenseConfig:
    """outputs is the number of classes, or 1 for a number (loss smooth_l1). rows is the size of a step over all tasks together."""

    width: int
    outputs: int
    hidden: int = 256
    dropout: float = 0.3
    rate: float = 3e-4
    decay: float = 1e-2
    rows: int = 256
    epochs: int = 40
    patience: int = 8
    tasks: int = 2
    loss: str = "cross_entropy"
    seed: int = 42

    def __post_init__(self):
        if self.loss not in ("cross_entropy", "smooth_l1") or (self.loss == "smooth_l1") != (self.outputs == 1):
            raise ValueError("cross_entropy has two outputs or more, smooth_l1 has one")


def start(config: DenseConfig) -> dict[str, np.ndarray]:
    r = np.random.default_rng(config.seed)
    sizes = [config.width, config.hidden, max(1, config.hidden // 2), config.outputs]
    out = {"scale": np.ones(config.width), "shift": np.zeros(config.width)}
    for i, (a, b) in enumerate(zip(sizes, sizes[1:]), 1):
        out[f"w{i}"], out[f"b{i}"] = (r.uniform(-1, 1, s) / np.sqrt(a) for s in ((a, b), (b,)))
    return out


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x times the normal distribution's share below x, and the derivative; the share by a rational form with an error under 1.2e-7."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = np.zeros_like(z)
    for c in reversed(terms):
        power = power * t + c
    tail = t * np.exp(-z * z + power) / 2
    share = np.where(x >= 0, 1 - tail, tail)
    return x * share, share + x * np.exp(-x * x / 2) / np.sqrt(2 * np.pi)


def forward(p: dict[str, np.ndarray], x: np.ndarray, masks: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple]:
    """Outputs, and what the way back needs. masks are what dropout leaves, scaled up."""
    mean = x.mean(1, keepdims=True)
    spread = np.sqrt(x.var(1, keepdims=True) + 1e-5)
    unit = (x - mean) / spread
    n = unit * p["scale"] + p["shift"]
    h1, d1 = _gelu(n @ p["w1"] + p["b1"])
    h1 = h1 if masks is None else h1 * masks[0]
    h2, d2 = _gelu(h1 @ p["w2"] + p["b2"])
    h2 = h2 if masks is None else h2 * masks[1]
    return h2 @ p["w3"] + p["b3"], (unit, n, h1, d1, h2, d2)


def loss_and_slope(config: DenseConfig, out: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted sum of losses and its derivative by the outputs."""
    if config.loss == "smooth_l1":
        d = out[:, 0] - y
        near = np.abs(d) < 1
        return float((w * np.where(near, d * d / 2, np.abs(d) - 0.5)).sum()), (w * np.where(near, d, np.sign(d)))[:, None]
    z = out - out.max(1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
    k = y.astype(int)
    return float(-(w * log_p[np.arange(len(k)), k]).sum()), w[:, None] * (np.exp(log_p) - (k[:, None] == np.arange(out.shape[1])))


def backward(p: dict[str, np.ndarray], kept: tuple, slope: np.ndarray, masks: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    unit, n, h1, d1, h2, d2 = kept
    g2 = slope @ p["w3"].T
    g2 = (g2 if masks is None else g2 * masks[1]) * d2
    g1 = g2 @ p["w2"].T
    g1 = (g1 if masks is None else g1 * masks[0]) * d1
    gn = g1 @ p["w1"].T
    return {"scale": (gn * unit).sum(0), "shift": gn.sum(0), "w1": n.T @ g1, "b1": g1.sum(0), "w2": h1.T @ g2, "b2": g2.sum(0), "w3": h2.T @ slope, "b3": slope.sum(0)}


def step(config: DenseConfig, p: dict, moments: tuple[dict, dict], g: dict, count: int) -> None:
    """One step of decoupled weight decay with running moments, in place."""
    first, second = moments
    for name in NAMES:
        p[name] *= 1 - config.rate * config.decay
        first[name] = 0.9 * first[name] + 0.1 * g[name]
        second[name] = 0.999 * second[name] + 0.001 * g[name] * g[name]
        p[name] -= config.rate * (first[name] / (1 - 0.9**count)) / (np.sqrt(second[name] / (1 - 0.999**count)) + 1e-8)


class Dense:
    def __init__(self, config: DenseConfig, parameters: dict[str, np.ndarray], history: list[float], best_epoch: int):
        self.config, self.parameters, self.history, self.best_epoch = config, parameters, history, best_epoch

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """df with prediction, the likeliest class (ties: the smallest) or the number, and outputs."""

        def score(model: Dense, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
            out = forward(model.parameters, rows.columns(np.arange(model.config.width)))[0]
            return (out[:, 0] if model.config.outputs == 1 else np.round(out, 12).argmax(1).astype(float)), out

        return scored(df, features, self, score, "outputs")


def _pack(arrays: dict) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def _read(folder: str) -> dict[str, np.ndarray] | None:
    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{root}/state").type.name == "NotFound":
        return None
    with store.open_input_stream(f"{root}/state") as f:
        return _unpack(f.read())


def _write(folder: str, state: dict) -> None:
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{(draft := uuid.uuid4().hex)}") as f:
        f.write(_pack(state))
    store.move(f"{root}/{draft}", f"{root}/state")


class Alone:
    """A single task."""

    rank, size = 0, 1

    def gathered(self, data: bytes) -> list[bytes]:
        return [data]

    def close(self) -> None:
        pass


class Together:
    """The tasks of a barrier stage, connected to the first one: the context's own exchange, which takes a second, tells only where it listens.

    A task that is lost breaks the connections, which ends the others, and the stage runs again.
    """

    def __init__(self, context: BarrierTaskContext):
        self.rank, tasks = context.partitionId(), context.getTaskInfos()
        self.size = len(tasks)
        key = uuid.uuid4().hex.encode()
        listener = Listener(("", 0), backlog=self.size, authkey=key) if self.rank == 0 else None
        port, key = context.allGather(f"{listener.address[1]} {key.decode()}" if listener else "")[0].split(" ")
        if listener:
            found = [listener.accept() for _ in range(self.size - 1)]
            self.peers = [peer for _, peer in sorted(((int(p.recv_bytes()), p) for p in found), key=lambda x: x[0])]
            listener.close()
        else:
            self.peers = [Client((tasks[0].address.split(":")[0], int(port)), authkey=key.encode())]
            self.peers[0].send_bytes(str(self.rank).encode())

    def gathered(self, data: bytes) -> list[bytes]:
        """Every task's bytes, in the order of the tasks."""
        if self.rank:
            self.peers[0].send_bytes(data)
            return [self.peers[0].recv_bytes() for _ in range(self.size)]
        all_ = [data, *(p.recv_bytes() for p in self.peers)]
        for p in self.peers:
            for x in all_:
                p.send_bytes(x)
        return all_

    def close(self) -> None:
        for p in self.peers:
            p.close()


def _summed(team: Alone | Together, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The tasks' arrays added up, in the order of the tasks, so each one gets the same bits."""
    flat = np.concatenate([np.ravel(v) for v in arrays.values()]).astype(np.float64)
    total = sum((np.frombuffer(x) for x in team.gathered(flat.tobytes())), np.zeros(len(flat)))
    cuts = np.cumsum([np.size(v) for v in arrays.values()])[:-1]
    return {k: part.reshape(np.shape(v)) for (k, v), part in zip(arrays.items(), np.split(total, cuts))}


def train_share(config: DenseConfig, x: np.ndarray, y: np.ndarray, w: np.ndarray, key: np.ndarray, held: np.ndarray, folder: str, team: Alone | Together) -> dict:
    """Trains on a task's share of the rows, alongside the others, from the folder's state on; returns the final state.

    Steps, dropout and order follow from seed, epoch, task and key. An epoch without a better loss on the held-out rows counts towards patience.
    """
    order = np.argsort(key, kind="stable")
    x, y, w, key, held = (a[order] for a in (x, y, w, key, held))
    xt, yt, wt, kt = x[~held], y[~held], w[~held], key[~held]
    xh, yh, wh = x[held], y[held], w[held]
    state = _read(folder)
    if state is None:
        p = start(config)
        first, second, best = ({k: v * f for k, v in p.items()} for f in (0, 0, 1))
        epoch, count, waited, best_epoch, best_loss, history = 0, 0, 0, 0, np.inf, []
    else:
        p, first, second, best = ({k: state[f"{i}-{k}"].copy() for k in NAMES} for i in ("p", "m", "v", "best"))
        epoch, count, waited, best_epoch = (int(i) for i in state["numbers"])
        best_loss, history = float(state["best_loss"]), state["history"].tolist()
    sizes = [int(n) for n in team.gathered(str(len(xt)).encode())]
    share = max(1, config.rows // len(sizes))
    steps = -(-max(sizes) // share)
    while epoch < config.epochs and waited < config.patience:
        turn = np.argsort(hashed_share(config.seed, epoch, kt), kind="stable")
        for i in range(steps):
            own = turn[i * share : (i + 1) * share]
            masks = None
            if config.dropout:
                masks = tuple((hashed_share(config.seed + 1 + layer, epoch, kt[own][:, None], np.arange(n)) >= config.dropout) / (1 - config.dropout) for layer, n in enumerate((p["w2"].shape[0], p["w3"].shape[0])))
            out, kept = forward(p, xt[own], masks)
            _, slope = loss_and_slope(config, out, yt[own], wt[own])
            g = _summed(team, backward(p, kept, slope, masks) | {"weight": np.array(wt[own].sum())})
            total = float(g.pop("weight"))
            if total > 0:
                count += 1
                step(config, p, (first, second), {k: v / total for k, v in g.items()}, count)
        seen = _summed(team, {"loss": np.array(loss_and_slope(config, forward(p, xh)[0], yh, wh)[0] if len(xh) else 0.0), "weight": np.array(wh.sum())})
        loss = float(seen["loss"] / seen["weight"]) if seen["weight"] > 0 else 0.0
        epoch, history = epoch + 1, [*history, loss]
        if loss < best_loss - 1e-9 or not seen["weight"] > 0:
            best, best_loss, best_epoch, waited = {k: v.copy() for k, v in p.items()}, loss, epoch, 0
        else:
            waited += 1
        if team.rank == 0:
            _write(folder, {f"{i}-{k}": d[k] for i, d in (("p", p), ("m", first), ("v", second), ("best", best)) for k in NAMES} | {"numbers": np.array([epoch, count, waited, best_epoch]), "best_loss": np.array(best_loss), "history": np.array(history)})
        team.gathered(b"")  # no task goes on before the state is kept
    return {"best": best, "history": history, "best_epoch": best_epoch}


def train_dense(df: DataFrame, config: DenseConfig, features: str = "features", label: str = "label", key: str = "row_id", held: str = "held", weight: str | None = None, folder: str | None = None) -> Dense:
    """A dense head trained on the rows where held is false, stopped by those where it is true; it keeps the coefficients of the best epoch.

    Rows with a null label, key or held, or without weight take no part; features beyond the width are left out. A task holds its share of the
    rows as a matrix, so tasks are to be as many as the cluster runs at once and as the rows need. With a folder that holds an earlier call's state it goes on from there.
    """
    folder = folder or f"{shared_dir(df.sparkSession)}/dense-{uuid.uuid4().hex}"
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    source = df.withColumns({"_y": F.col(label).cast("double"), "_w": w, "_k": F.xxhash64(F.col(key)), "_h": F.col(held).cast("boolean"), "_n": F.col(key).isNull()})
    rows = entries(source.where("_y IS NOT NULL AND NOT isnan(_y) AND _w > 0 AND _h IS NOT NULL AND NOT _n"), features, "_y", "_w", "_k", "_h").repartition(config.tasks, "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        parts = [(Rows(b).columns(np.arange(config.width)), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w", "_k", "_h"))) for b in batches]
        empty = (np.zeros((0, config.width)), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))
        x, y, w, k, h = (np.concatenate(c) for c in zip(empty, *parts))
        team = Together(context)
        try:
            train_share(config, x, y, w, k.astype(np.int64), h.astype(bool), folder, team)
        finally:
            team.close()
        yield pa.RecordBatch.from_pydict({"rank": pa.array([team.rank], pa.int64())})

    rows.mapInArrow(run, "rank long", barrier=True).agg(F.count("*")).first()
    state = _read(folder)
    if state is None:  # no epoch was asked for
        return Dense(config, start(config), [], 0)
    return Dense(config, {k: state[f"best-{k}"] for k in NAMES}, state["history"].tolist(), int(state["numbers"][3]))
