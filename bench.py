"""Times the headline queries on the driver tables; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from thrustlog import registry  # noqa: E402
from thrustlog.session import local_session  # noqa: E402

HEADLINE = [
    "run_summary",
    "batch_run_summary",
    "cumulative_impulse",
    "axis_bounds",
    "deinterleave",
    "packet_decode",
    "accepted_batches",
    "convert_sensors",
    "wide_scans",
    "wide_pivot",
    "calibrated_code",
    "calibrate_config",
    "parse_messages",
    "relay_timeline",
    "sessions",
    "readings_in_session",
    "state_as_of",
    "ack_match",
    "latest_n",
]


def timed(spark, query, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    all_queries = registry.queries()
    timed(spark, all_queries["run_summary"], sf_dir)  # starts the session's code paths
    seconds = {name: timed(spark, all_queries[name], sf_dir) for name in names}
    print(json.dumps({
        "metric": "telemetry_headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
