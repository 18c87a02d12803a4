"""Block scan against a plain fold, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from thrustlog.plans.scan import (
    key_total,
    last_value,
    next_value,
    number_block,
    positions,
    previous_value,
    running,
    running_sum,
)


def rows(seed, count=400):
    rng = random.Random(seed)
    made = []
    for i in range(count):
        key = "hot" if rng.random() < 0.6 else rng.choice("abcde")
        value = rng.randint(-9, 9) if rng.random() < 0.5 else None
        made.append((key, i * rng.choice([1, 1, 1, 7]) % 5003, i, value))
    return made


def fold(made):
    expected = {}
    for key in {r[0] for r in made}:
        mine = sorted((r for r in made if r[0] == key), key=lambda r: (r[1], r[2]))
        values = [r[3] for r in mine]
        for place, row in enumerate(mine):
            before = [v for v in values[:place] if v is not None]
            upto = [v for v in values[: place + 1] if v is not None]
            after = [v for v in values[place + 1:] if v is not None]
            expected[row[2]] = (
                sum(before),
                sum(upto),
                sum(v for v in values if v is not None),
                upto[-1] if upto else None,
                before[-1] if before else None,
                after[0] if after else None,
            )
    return expected


@pytest.mark.parametrize("width", [1, 17, 1000, 10**9])
def test_running_equals_fold(spark, width):
    made = rows(width)
    df = spark.createDataFrame(made, "key string, at long, id long, value long")
    got = running(
        df, ["key"], ["at", "id"], number_block(F.col("at"), width),
        before=running_sum(F.col("value"), exclusive=True),
        upto=running_sum(F.col("value")),
        total=key_total(F.col("value")),
        last=last_value(F.col("value")),
        prev=previous_value(F.col("value")),
        next=next_value(F.col("value")),
    ).collect()
    expected = fold(made)
    assert len(got) == len(made)
    for r in got:
        want = expected[r.id]
        assert (r.before, r.upto, r.total or 0, r["last"], r.prev, r["next"]) == want


def test_positions(spark):
    made = rows(3)
    df = spark.createDataFrame(made, "key string, at long, id long, value long")
    got = positions(df, ["key"], ["at", "id"], number_block(F.col("at"), 50)).collect()
    for key in {r.key for r in got}:
        mine = sorted((r for r in got if r.key == key), key=lambda r: (r["at"], r.id))
        assert [r.pos for r in mine] == list(range(len(mine)))
        assert {r.n for r in mine} == {len(mine)}


def test_one_key_is_spread_over_tasks(spark):
    spread = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20000).select(F.lit("hot").alias("key"), F.col("id").alias("at"))
        got = positions(df, ["key"], ["at"], number_block(F.col("at"), 100))
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20000 and max(sizes) < 10000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", spread)
