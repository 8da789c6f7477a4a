"""

Usage: python scripts/als_probe.py [SF_DIR] [CPUS]

Same setup as the baseline's own probes: the ratings view at the given scale,
``local[2]`` and 4 shuffle partitions by default, an 80/20 random split with
seed 42, cold start ``drop``; the time covers fit, RMSE and two counts.
Prints one JSON line per configuration.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ratelake.jobs import ALS_CONFIGS  # noqa: E402
from ratelake.operators import model as M  # noqa: E402
from ratelake.plans import fixtures as FX  # noqa: E402
from ratelake.session import build_session  # noqa: E402


def probe(spark, sf_dir: str) -> dict[str, dict]:
    ratings = FX.ratings(spark, sf_dir).select("userId", "movieId", "rating")
    out = {}
    for name in ("A", "B"):
        cfg = dict(ALS_CONFIGS[name])
        cfg["cold_start"] = "drop"
        t0 = time.perf_counter()
        train, test = M.random_split(ratings, 0.8, seed=42)
        model = M.train(train, seed=42, **cfg)
        scored = M.score(model, test)
        rmse = M.rmse(scored).first()["rmse"]
        n_train, n_scored = train.count(), scored.count()
        took = time.perf_counter() - t0
        out[name] = {"sec": round(took, 2), "rmse": round(rmse, 4), "train_rows": n_train, "scored_rows": n_scored}
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    cpus = int(sys.argv[2]) if len(sys.argv) > 2 else 2
    spark = build_session(f"local[{cpus}]", app_name="als-probe", shuffle_partitions=4)
    for name, result in probe(spark, sf_dir).items():
        print(json.dumps({"config": name, **result, "cpus": cpus, "sf_dir": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
