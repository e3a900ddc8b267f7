"""python -m weftline build RAW.csv OUT | train SPLITS [--model M] [--task T] [--set KEY=VALUE] | predict SPLITS ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.features import PrepConfig
from .operators.models import parse_overrides
from .plans.training import TrainConfig, build_splits, train
from .sources.tables import append_log, read_raw_csv


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="job", required=True)
    b = sub.add_parser("build")
    b.add_argument("raw")
    b.add_argument("out")
    b.add_argument("--hash-split", action="store_true")
    t = sub.add_parser("train")
    t.add_argument("splits")
    t.add_argument("--model", default="logreg")
    t.add_argument("--task", default="category")
    t.add_argument("--texts", nargs="+", default=["job_title", "description"])
    t.add_argument("--eval", default="dev")
    t.add_argument("--confirm-test", action="store_true")
    t.add_argument("--set", nargs="*", default=[])
    t.add_argument("--log")
    t.add_argument("--scope", choices=["title", "structured", "full"], help="assembled features of this scope; hashed words otherwise")
    t.add_argument("--svd", type=int, help="project the assembled features on so many singular directions")
    for flag in ("segment", "charfold", "province", "stopwords"):
        t.add_argument(f"--{flag}", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.job == "build":
        print(build_splits(spark, read_raw_csv(spark, a.raw), a.out, greedy=not a.hash_split)["splits"])
    else:
        prep = PrepConfig(a.segment, a.charfold, a.province, a.stopwords)
        config = TrainConfig(a.task, a.model, tuple(a.texts), evaluate=a.eval, confirm_test=a.confirm_test, overrides=parse_overrides(a.set), scope=a.scope, prep=prep, svd=a.svd)
        metrics = train(spark.read.parquet(a.splits), config)[1]
        metrics.show()
        if a.log:
            append_log(metrics.selectExpr(f"'{config.label}' AS run", "*"), a.log)


if __name__ == "__main__":
    main()
