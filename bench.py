"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from skein.operators.fact_store import FactStore
from skein.operators.facts import micros
from skein.plans import catalog, facts, incremental
from skein.session import ensure_checkpoint_dir, local_session

HEADLINE = (
    "bm25_batch", "dense_batch_topk", "rrf_fusion", "weighted_fusion", "dedup_anti_join", "dataset_type",
    "query_route", "semantic_chunks", "sentence_window", "raptor_windows", "entity_merge", "relation_merge",
    "graph_hops", "connected_orders", "facts_succession", "facts_point_in_time",
)


def timed(took: dict, name: str, run) -> object:
    start = time.perf_counter()
    found = run()
    took[name] = round(time.perf_counter() - start, 3)
    return found


def noop(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def stored_lookup(spark, sf_dir: str, took: dict) -> None:
    """A store of all facts, built in one batch, and a lookup in it: two lines of their own."""
    store = FactStore(spark, incremental.folder(spark, "bench"))
    timed(took, "fact_store_build", lambda: store.upsert(facts.raw_facts(spark, sf_dir)))
    middle = (micros(F.min("ts")) + micros(F.max("ts"))) / 2
    when = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.floor(middle)).first()[0]
    timed(took, "fact_store_lookup", lambda: noop(store.at(F.lit(when)).select("fact_id", "subject", "relation")))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    found, took = catalog.queries(), {}
    noop(found["list_sources"](spark, sf_dir))
    for name in HEADLINE:
        timed(took, name, lambda name=name: noop(found[name](spark, sf_dir)))
        spark.catalog.clearCache()
    stored_lookup(spark, sf_dir, took)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
