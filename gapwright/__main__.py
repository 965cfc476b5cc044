"""python -m gapwright COMMAND --data FILE --root FOLDER [options]: the experiment's steps from the shell."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.shipping import ship
from .plans.experiment import COMMANDS, LAYERS, Experiment
from .sources.datasets import ADULT, GERMAN, read_table

SPECS = {s.name: s for s in (ADULT, GERMAN)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gapwright", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--data", required=True, help="the clean CSV, with a header")
    p.add_argument("--root", required=True, help="where artefacts go")
    p.add_argument("--dataset", choices=sorted(SPECS), default=ADULT.name)
    p.add_argument("--balance", choices=("no_balance", "twostage", "stratified", "redistribution"), default="no_balance")
    p.add_argument("--protected", help="the protected group of two-stage balancing")
    p.add_argument("--sources", nargs="+", default=["clean"])
    p.add_argument("--seeds", nargs="+", type=int, default=[42])
    p.add_argument("--rates", nargs="+", type=int, default=[10])
    p.add_argument("--strategies", nargs="+", default=["mode"])
    p.add_argument("--layers", nargs="+", type=int, default=list(LAYERS))
    p.add_argument("--exclude", nargs="*", default=[], help="columns that take no nulls")
    p.add_argument("--epochs", type=int, default=200)
    p.add_argument("--log", help="a file for the log, besides the console")
    for flag in ("force-graph", "force-train", "skip-download", "single-seed", "overwrite"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    handlers: list[logging.Handler] = [logging.StreamHandler()] + ([logging.FileHandler(a.log)] if a.log else [])
    logging.basicConfig(level=logging.INFO, handlers=handlers, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = spark or SparkSession.builder.appName("gapwright").getOrCreate()
    ship(spark)
    spec = SPECS[a.dataset]
    clean = read_table(spark, spec, a.data)
    clean = clean.withColumn("row_id", F.monotonically_increasing_id())  # the splits are written with it, once
    e = Experiment(clean, spec, a.root, protected=a.protected, epochs=a.epochs)
    COMMANDS[a.command](e, a).show(200, truncate=False)


if __name__ == "__main__":
    main()
