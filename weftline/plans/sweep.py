"""Sweeps that survive: a plan in waves, a journal of claims and outcomes in shared storage, and a driver loop that goes on where it stopped."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Cell:
    """One run of a sweep. estimate and limit are seconds; a reason in `gives_up` says that it is known not to finish."""

    model: str
    number: int
    overrides: dict = field(default_factory=dict)
    estimate: float = 0.0
    limit: float | None = None
    gives_up: str = ""

    @property
    def id(self) -> str:
        return f"{self.model}-{self.number}"


def planned(cells: Iterable[Cell], must_state: dict[str, set[str]] | None = None) -> list[Cell]:
    """Wave by wave, the cheapest first in each: every model's first configuration comes before any second one.

    Models in must_state have to state these parameters, as their defaults are known to be too slow; two cells of one id are an error.
    """
    out = sorted(cells, key=lambda c: (c.number, c.estimate, c.model))
    if len({c.id for c in out}) < len(out):
        raise ValueError("two cells have the same id")
    for c in out:
        if missing := (must_state or {}).get(c.model, set()) - c.overrides.keys():
            raise ValueError(f"{c.id} must state {sorted(missing)}")
    return out


class Journal:
    """Claims and outcomes as files that are made once, by Spark's own file systems: of two sweeps that claim a cell, one gets it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _made(self, name: str, content: dict) -> bool:
        """Whether this call made the file; one that is there stays as it is."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception:
            if self._fs.exists(self._path(name)):
                return False
            raise
        stream.write(json.dumps(content).encode())
        stream.close()
        return True

    def _read(self, kind: str) -> dict[str, dict]:
        if not self._fs.exists(self._path(kind)):
            return {}
        rows = self.spark.read.text(f"{self.folder}/{kind}", wholetext=True).collect()  # a row for each cell
        found = [json.loads(r["value"]) for r in rows if r["value"]]
        return {x["id"]: x for x in found}

    def opened(self, state: str) -> None:
        """Binds the journal to what the runs depend on (code and data); another state is refused, as its results don't compare."""
        if self._made("state/this.json", {"id": "state", "state": state}):
            return
        known = self._read("state")["state"]["state"]
        if known != state:
            raise ValueError(f"the journal was begun in state {known}, not {state}")

    def claim(self, cell: Cell, worker: str) -> bool:
        return self._made(f"claims/{cell.id}.json", {"id": cell.id, "worker": worker, "at": time.time()})

    def finish(self, cell: Cell, outcome: str, **facts) -> None:
        self._made(f"outcomes/{cell.id}.json", {"id": cell.id, "model": cell.model, "number": cell.number, "overrides": cell.overrides, "outcome": outcome} | facts)

    def claims(self) -> dict[str, dict]:
        return self._read("claims")

    def outcomes(self) -> dict[str, dict]:
        return self._read("outcomes")

    def report(self) -> DataFrame:
        """(id, model, outcome, score, seconds, why), a row for each cell that has an outcome."""
        rows = [(x["id"], x["model"], x["outcome"], x.get("score"), x.get("seconds"), x.get("why", "")) for x in self.outcomes().values()]
        return self.spark.createDataFrame(rows, "id string, model string, outcome string, score double, seconds double, why string")


def run_sweep(plan: list[Cell], run: Callable[[Cell], float], journal: Journal, state: str, deadline: float | None = None, clock: Callable[[], float] = time.monotonic) -> list[str]:
    """Runs what has no outcome yet, in the plan's order, and returns the ids that this call has run.

    A cell whose estimate passes the deadline ends the call: a later one goes on. A claim without outcome is a run that died, so it is
    recorded as not finished ("dnf") and not run again; so are cells that are known not to finish and those that pass their limit, whose Spark jobs are
    cancelled. A run that raises is recorded as failed, and the sweep goes on.
    """
    journal.opened(state)
    done, claimed, worker, ran = journal.outcomes(), journal.claims(), uuid.uuid4().hex, []
    for cell in plan:
        if cell.id in done:
            continue
        if cell.gives_up:
            journal.finish(cell, "dnf", why=cell.gives_up)
            continue
        if cell.id in claimed:
            journal.finish(cell, "dnf", why=f"claimed by {claimed[cell.id]['worker']}, which never reported")
            continue
        if deadline is not None and clock() + cell.estimate > deadline:
            break
        if not journal.claim(cell, worker):
            continue  # another sweep was faster
        ran.append(cell.id)
        began, late, context = clock(), threading.Event(), journal.spark.sparkContext
        context.setJobGroup(f"sweep-{worker}-{cell.id}", cell.id, True)

        def stop(event=late, group=f"sweep-{worker}-{cell.id}") -> None:
            event.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(cell.limit, stop) if cell.limit is not None else None
        if timer:
            timer.daemon = True
            timer.start()
        try:
            score = float(run(cell))
        except Exception as e:
            if late.is_set():
                journal.finish(cell, "dnf", seconds=clock() - began, why=f"took more than {cell.limit:g} seconds")
            else:
                journal.finish(cell, "failed", seconds=clock() - began, why=f"{type(e).__name__}: {str(e)[:300]}")
        else:
            journal.finish(cell, "done", score=score, seconds=clock() - began)
        finally:
            if timer:
                timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
    return ran
