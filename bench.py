"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] (4 unless told), after a warm-up, beside
DuckDB on as many threads over the same files; prints one JSON line."""

from __future__ import annotations

import glob
import json
import os
import time

import duckdb

from parcelon.plans import registry
from parcelon.session import session

HEADLINE = ["key_zone_table", "box_split", "ring_area_sphere", "ring_area_grs80", "arc_length", "segment_stats", "drop_small_rings", "point_in_ring", "bbox_self_overlap", "nearest_within", "radius_pairs", "knn_other_feature", "key_reconcile", "attr_mismatches", "multiset_except", "fingerprint", "void_classify", "sequential_ids"]
REPEATS = 3


def best(run) -> float:
    """The best of REPEATS runs after one that does not count."""
    run()
    took = []
    for _ in range(REPEATS):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return round(min(took), 4)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = session(f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    taken = {n: best(lambda n=n: registry.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()) for n in HEADLINE}
    spark.stop()
    duck = duckdb.connect(config={"threads": int(cpus)})
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    beside = {n: best(lambda n=n: duck.execute(registry.SQL[n]).arrow()) for n in HEADLINE}
    shown = {"metric": "total of the best of three runs after a warm-up", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "cpus": int(cpus), "duckdb": beside, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(shown))


if __name__ == "__main__":
    main()
