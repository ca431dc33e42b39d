"""python -m cellarflow run|lookup: a batch run over a folder of tables, and a look at the rows of a user."""

from __future__ import annotations

import argparse
import json
import sys
import tomllib
from datetime import datetime

from pyspark.sql import SparkSession

from cellarflow.config import SHOP, ConfigError, JobSettings, load_features, parse_job
from cellarflow.operators.lookup import lookup_or_fallback, request_size
from cellarflow.plans.pipeline import run_job
from cellarflow.runtime import release
from cellarflow.sources.tables import Store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cellarflow")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="read events, users and items, write recommendations")
    run.add_argument("root")
    run.add_argument("--features", help="TOML file of event weights, features, boosts and blending")
    run.add_argument("--job", help="TOML file with a [job] table")
    run.add_argument("--as-of", type=datetime.fromisoformat, help="the time that ages are counted from; default now")
    look = commands.add_parser("lookup", help="print the rows of a user as JSON")
    look.add_argument("root")
    look.add_argument("user")
    look.add_argument("--limit", type=int)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("cellarflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.root)
    try:
        if args.command == "run":
            job = JobSettings()
            if args.job:
                with open(args.job, "rb") as f:
                    job = parse_job(tomllib.load(f))
            print(json.dumps(run_job(spark, store, load_features(args.features) if args.features else SHOP, job, as_of=args.as_of)))
            release(spark)
        else:
            user = spark.createDataFrame([(args.user,)], "user_id string")
            rows = lookup_or_fallback(store.read_recommendations(), user, request_size(args.limit, None, 10)).orderBy("place")
            print(json.dumps([r.asDict() for r in rows.collect()]))  # at most 100 rows
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
