import pytest
from pyspark.sql import functions as F

from weftline.plans.sweep import Cell, Journal, planned, run_sweep


def cells():
    return planned([Cell("b", 1, estimate=5), Cell("a", 1, {"c": 1}, estimate=9), Cell("a", 2, {"c": 2}, estimate=1), Cell("b", 2, estimate=2), Cell("slow", 1, estimate=100, gives_up="needs hours")])


def test_plan_is_in_waves_and_states_what_it_must():
    assert [c.id for c in cells()] == ["b-1", "a-1", "slow-1", "a-2", "b-2"]
    with pytest.raises(ValueError):
        planned([Cell("a", 1), Cell("a", 1)])
    with pytest.raises(ValueError, match="must state"):
        planned([Cell("a", 1, {"depth": 3})], {"a": {"depth", "rounds"}})


def test_a_killed_sweep_goes_on_with_the_rest(spark, tmp_path):
    journal, calls = Journal(spark, f"file://{tmp_path}/j"), []

    def run(cell):
        calls.append(cell.id)
        if cell.id == "a-1" and len(calls) == 2:
            raise KeyboardInterrupt  # the driver dies
        return spark.range(10).count() / 10 + cell.number

    with pytest.raises(KeyboardInterrupt):
        run_sweep(cells(), run, journal, "v1")
    assert calls == ["b-1", "a-1"] and set(journal.outcomes()) == {"b-1"} and set(journal.claims()) == {"b-1", "a-1"}
    assert run_sweep(cells(), run, Journal(spark, f"file://{tmp_path}/j"), "v1") == ["a-2", "b-2"]
    assert calls == ["b-1", "a-1", "a-2", "b-2"]
    got = {x["id"]: x for x in journal.report().collect()}
    assert {i: x["outcome"] for i, x in got.items()} == {"b-1": "done", "a-1": "dnf", "slow-1": "dnf", "a-2": "done", "b-2": "done"}
    assert got["b-2"]["score"] == 3 and got["slow-1"]["why"] == "needs hours" and "never reported" in got["a-1"]["why"]
    assert run_sweep(cells(), run, journal, "v1") == []
    with pytest.raises(ValueError, match="begun in state v1"):
        run_sweep(cells(), run, journal, "v2")


def test_deadline_limits_failures_and_rivals(spark, tmp_path):
    journal, now = Journal(spark, f"file://{tmp_path}/j"), [0.0]

    def run(cell):
        now[0] += 4
        if cell.id == "a-2":
            raise ZeroDivisionError("no data")
        return 1.0

    assert run_sweep(cells(), run, journal, "s", deadline=10, clock=lambda: now[0]) == ["b-1"]  # a-1 would end at 13
    assert journal.claim(next(c for c in cells() if c.id == "b-2"), "other")  # a rival, after the claims were read
    read = journal.claims
    journal.claims = lambda: {k: v for k, v in read().items() if k != "b-2"}
    assert run_sweep(cells(), run, journal, "s", clock=lambda: now[0]) == ["a-1", "a-2"]
    found = journal.outcomes()
    assert found["a-2"]["outcome"] == "failed" and "no data" in found["a-2"]["why"] and "b-2" not in found


def test_a_run_beyond_its_limit_is_cancelled(spark, tmp_path):
    @F.udf("long")
    def slow(x):
        import time

        time.sleep(0.2)
        return x

    journal = Journal(spark, f"file://{tmp_path}/j")
    plan = planned([Cell("a", 1, limit=3.0), Cell("b", 2, limit=60.0)])
    run_sweep(plan, lambda c: spark.range(10_000 if c.model == "a" else 10).select(F.sum(slow("id"))).first()[0], journal, "s")
    found = journal.outcomes()
    assert found["a-1"]["outcome"] == "dnf" and "more than 3 seconds" in found["a-1"]["why"]
    assert found["b-2"]["outcome"] == "done" and found["b-2"]["score"] == 45
