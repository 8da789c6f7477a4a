"""Command line: the reference's scripts and notebooks as subcommands.

    python -m ratelake count-csv PATH
    python -m ratelake prepare --movies M.csv --ratings R.csv --out ENRICHED
    python -m ratelake train --enriched ENRICHED --model MODEL [--config A|B]
    python -m ratelake score-stream --model MODEL --store STORE --checkpoint CKPT \\
        --rejects REJ --option kafka.bootstrap.servers=HOST:9092 \\
        --option subscribe=TOPIC [--starting-offsets latest|earliest]
    python -m ratelake compact --store STORE [--checkpoint CKPT ...] [--vacuum-hours 24]
    python -m ratelake dashboard --store STORE [--as-of 2024-01-30T12:00:00] [--item ID] [--user ID] [--out DIR]

``prepare --results DIR`` and ``dashboard --out DIR`` write every result whole, one Parquet
table each. What is printed is a preview of at most 20 rows.
"""

from __future__ import annotations

import argparse
import datetime as dt

import os

from pyspark.sql import DataFrame

from ratelake import jobs
from ratelake.operators import model as M
from ratelake.operators import quality as Q
from ratelake.session import build_session, remove_scratch
from ratelake.sources import tables as TB
from ratelake.streaming.store import PredictionStore


def _options(pairs: list[str] | None) -> dict[str, str]:
    out = {}
    for pair in pairs or []:
        key, _, value = pair.partition("=")
        out[key] = value
    return out


def _deliver(results: dict[str, DataFrame], out: str | None) -> None:
    """Write each result whole under ``out`` (if given) and print a preview."""
    for name, df in results.items():
        if out:
            df = df.sparkSession.read.parquet(TB.write_table(df, os.path.join(out, name)))
        print(f"== {name} (preview, at most 20 rows)")
        df.show(20, truncate=False)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ratelake")
    ap.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    sub = ap.add_subparsers(dest="cmd", required=True)

    c = sub.add_parser("count-csv", help="row count of a CSV with a header (schema inferred)")
    c.add_argument("path")

    p = sub.add_parser("prepare", help="profile, clean, join, enrich and write the rating table")
    p.add_argument("--movies", required=True)
    p.add_argument("--ratings", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--results", default=None, help="folder for every full result, one Parquet table each")
    p.add_argument("--parquet", action="store_true", help="inputs are Parquet, not CSV")

    t = sub.add_parser("train", help="fit ALS, print RMSE, save the model")
    t.add_argument("--enriched", required=True)
    t.add_argument("--model", required=True)
    t.add_argument("--config", default="A", choices=sorted(jobs.ALS_CONFIGS))
    t.add_argument("--blocks", type=int, default=None, help="ALS user/item blocks (default: from the number of rows, at least 10)")

    s = sub.add_parser("score-stream", help="score a message stream into the prediction store")
    s.add_argument("--model", required=True)
    s.add_argument("--store", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--rejects", required=True)
    s.add_argument("--format", default="kafka")
    s.add_argument("--option", action="append", help="source option KEY=VALUE (repeatable)")
    s.add_argument("--starting-offsets", default="latest", choices=["latest", "earliest", "default"])
    s.add_argument("--min-partitions", type=int, default=None)

    d = sub.add_parser("dashboard", help="print the dashboard queries over the prediction store")
    d.add_argument("--store", required=True)
    d.add_argument("--as-of", default=None, help="ISO time ending the 24 h window, or 'latest' (default: now, UTC)")

    d.add_argument("--item", type=int, default=None, help="also this item's statistics")
    d.add_argument("--user", type=int, default=None, help="also this user's best predictions")
    d.add_argument("--out", default=None, help="folder for every full result, one Parquet table each")

    f = sub.add_parser("compact", help="fold the store's closed micro-batches into sized, clustered files")
    f.add_argument("--store", required=True)
    f.add_argument("--checkpoint", action="append", default=[], help="checkpoint of an idle or ended stream (may be given several times)")
    f.add_argument("--vacuum-hours", type=float, default=24.0, help="delete folders folded longer ago than this")

    args = ap.parse_args(argv)
    spark = build_session(args.master, app_name=f"ratelake-{args.cmd}")

    if args.cmd == "count-csv":
        Q.row_count(TB.read_csv(spark, args.path)).show()
    elif args.cmd == "prepare":
        out = jobs.prepare_ratings(spark, args.movies, args.ratings, args.out, csv=not args.parquet)
        _deliver(out, args.results)
    elif args.cmd == "train":
        M.unusable_rows(TB.read_table(spark, args.enriched)).show()
        _, err = jobs.train_model(spark, args.enriched, args.model, config=args.config, blocks=args.blocks)
        err.show()
    elif args.cmd == "score-stream":
        offsets = None if args.starting_offsets == "default" else args.starting_offsets
        queries = jobs.start_scoring(
            spark,
            args.model,
            args.store,
            args.checkpoint,
            args.rejects,
            source_format=args.format,
            source_options=_options(args.option),
            starting_offsets=offsets,
            min_partitions=args.min_partitions,
        )
        spark.streams.awaitAnyTermination()
        for q in queries:
            q.stop()
        queries.release()
    elif args.cmd == "compact":
        store = PredictionStore(spark, args.store)
        done = store.compact(args.checkpoint)
        gone = store.vacuum(args.vacuum_hours * 3600)
        print(f"version {done.version}: {len(done.segments)} segments" if done else "nothing to fold", f"({gone} folders deleted)")
    elif args.cmd == "dashboard":
        as_of = args.as_of if args.as_of in (None, "latest") else dt.datetime.fromisoformat(args.as_of)
        _deliver(jobs.dashboard(spark, args.store, as_of=as_of, item_id=args.item, user_id=args.user), args.out)
    remove_scratch(spark)
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
