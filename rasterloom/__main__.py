"""python -m rasterloom select | evaluate | baseline | aggregate | manifest"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from rasterloom.operators import automatic, baselines, partition, stats, study
from rasterloom.session import get_session
from rasterloom.sources import files, scenes


def _scene(spark, args, labels: bool):
    where = {"envi": {"header": args.header, "cube": args.scene}, "matlab": {"cube": args.scene}}.get(args.kind, {"path": args.scene} if args.kind in scenes.LOADERS else {"data_dir": args.scene})
    return scenes.load_scene(spark, args.kind, subsample=args.subsample, labels=labels, **where)


def select(spark, args) -> dict:
    """Discover regions by one configuration, or by automatic selection over a grid, write them and print their lock. The reference labels are not read."""
    config = study.Configuration(**json.loads(args.config))
    if args.automatic:
        grid = automatic.Grid(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(args.grid).items()})
        found = automatic.candidates(_scene(spark, args, False), config, grid)
        pick = automatic.select_automatic(found, args.automatic)
        chosen = None if pick is None else found.entries[pick]
        if chosen is not None:
            found.labels(pick).write.mode("overwrite").parquet(args.out)
        about = {"abstains": True} if chosen is None else {"checkpoint": grid.checkpoints[chosen.t], "gamma": grid.gammas[chosen.g], "beta": chosen.beta, "tau": chosen.tau, "clusters": chosen.k}
        return about if chosen is None else about | study.lock(config, spark.read.parquet(args.out))
    labels = study.discover(_scene(spark, args, False), config)
    labels.write.mode("overwrite").parquet(args.out)
    return study.lock(config, spark.read.parquet(args.out))


def evaluate(spark, args) -> dict:
    """Compare frozen regions with reference labels (i, gt); a lock is verified first."""
    labels = spark.read.parquet(args.labels)
    if args.lock:
        study.check_lock(json.loads(args.lock), study.Configuration(**json.loads(args.config)), labels)
    truth = spark.read.parquet(args.truth).select("i", "gt")
    return partition.evaluate(labels.select("i", "label").join(truth, "i"), "gt", "label", 0)


def baseline(spark, args) -> dict:
    baselines.count_matched(_scene(spark, args, False), args.clusters, args.method, seed=args.seed).write.mode("overwrite").parquet(args.out)
    return {"out": args.out}


def aggregate(spark, args) -> dict:
    """Mean, deviation and count of a metric of repeated runs in a CSV file."""
    rows = files.read_csv(spark, args.runs).withColumn(args.metric, F.col(args.metric).cast("double"))
    files.write_csv(stats.repeat_aggregate(rows, ["dataset", "method"], args.metric), args.out)
    return {"out": args.out}


def manifest(spark, args) -> dict:
    files.write_checksums(files.manifest(spark, args.folder), args.out)
    return {"out": args.out}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rasterloom", description=__doc__)
    parser.add_argument("--master")
    commands = parser.add_subparsers(dest="command", required=True)
    add = {f.__name__: commands.add_parser(f.__name__, help=f.__doc__) for f in (select, evaluate, baseline, aggregate, manifest)}
    for name in ("select", "baseline"):
        add[name].add_argument("scene")
        add[name].add_argument("--kind", default="vectors", choices=[*scenes.LOADERS, *scenes.ENVI_SCENES, *scenes.MATLAB_SCENES], help="a kind of file, or a public scene whose data folder is given")
        add[name].add_argument("--header")
        add[name].add_argument("--subsample", type=int)
    for name in ("select", "evaluate"):
        add[name].add_argument("--config", default="{}", help="entries of the configuration, as JSON")
    add["select"].add_argument("--automatic", type=int, choices=[1, 2], help="select over the grid by this version of the rule")
    add["select"].add_argument("--grid", default="{}", help="entries of the grid, as JSON")
    for name in ("select", "baseline", "aggregate", "manifest"):
        add[name].add_argument("--out", required=True)
    add["evaluate"].add_argument("labels")
    add["evaluate"].add_argument("truth")
    add["evaluate"].add_argument("--lock")
    add["baseline"].add_argument("--method", default="kmeans", choices=["kmeans", "minibatch", "fcm", "slic"])
    add["baseline"].add_argument("--clusters", type=int, required=True)
    add["baseline"].add_argument("--seed", type=int, default=0)
    add["aggregate"].add_argument("runs")
    add["aggregate"].add_argument("--metric", default="ari")
    add["manifest"].add_argument("folder")
    args = parser.parse_args(argv)
    print(json.dumps(globals()[args.command](get_session(master=args.master), args), default=str))


if __name__ == "__main__":
    main()
