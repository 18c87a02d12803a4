import re
import zlib

import pytest
from pyspark.sql import functions as F

from thrustlog.llm import ring_shards


def check(rows, shards, least=None, most=None):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert (least is None or min(sizes) >= least) and (most is None or max(sizes) <= most)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_counts_differ_by_one_at_most(docs):
    rows = ring_shards.digest(docs, 24).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1000))
    check(rows, 24, 41, 42)
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)


def test_a_hot_key_is_spread(spark):
    hot = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"),
        F.lit(1).alias("slot"), F.lit("a").alias("spot"), F.lit(2).alias("n"), F.lit(3).alias("row"),
    )
    placed = ring_shards.assigned(hot, 24)
    assert placed.columns == ["doc_id", "text", "spot", "n", "row", "shard", "slot"]
    check(placed.collect(), 24, 250, 250)


@pytest.mark.parametrize("kind", ["dropDuplicates", "groupBy", "join", "repartition", "union"])
def test_shuffled_input_loses_no_row(spark, docs, kind):
    ids = docs.select("doc_id")
    made = {
        "dropDuplicates": lambda: docs.dropDuplicates(["doc_id"]),
        "groupBy": lambda: docs.groupBy("doc_id").agg(F.max("text").alias("text")),
        "join": lambda: ids.join(docs, "doc_id", "left"),
        "repartition": lambda: docs.repartition(64),
        "union": lambda: docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 2 = 1").repartition(7, "doc_id")),
    }[kind]()
    rows = ring_shards.assigned(made, 24).select("doc_id", "shard", "slot").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1000))
    check(rows, 24, 41, 42)


@pytest.mark.parametrize("balance", [None, 1.1, 2.0])
def test_against_a_plain_walk_round_the_ring(spark, docs, balance):
    shards, nodes, spots = 24, 64, 8192
    ring_nodes, owned = ring_shards.ring(spark, shards, nodes, spots)
    shard_of = dict(map(tuple, ring_nodes.collect()))
    home = {r["spot"]: r["node"] for r in owned.collect()}
    spot_of = dict(map(tuple, docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(spots)).cast("int")).collect()))
    most = [r for r in spark.range(1).select(ring_shards.bounds(1000, shards, balance)).first()[0]]
    held, over, expected = [0] * shards, {}, {}
    for spot in sorted(set(spot_of.values())):  # own keys first, in ring order
        n, shard = sum(s == spot for s in spot_of.values()), shard_of[home[spot]]
        stays = min(n, most[shard] - held[shard])
        held[shard] += stays
        expected[spot] = [shard] * stays
        over.setdefault(home[spot], []).extend([spot] * (n - stays))
    queue = []
    for step in range(2 * len(shard_of)):  # then those beyond the bound, clockwise, first come first served
        shard = shard_of[step % len(shard_of)]
        taken = min(len(queue), most[shard] - held[shard])
        held[shard] += taken
        for spot in queue[:taken]:
            expected[spot].append(shard)
        queue = queue[taken:] + (over.get(step, []) if step < len(shard_of) else [])
    assert not queue
    got = {}
    for r in ring_shards.assigned(docs, shards, balance=balance).select("doc_id", "shard").collect():
        got.setdefault(spot_of[r["doc_id"]], []).append(r["shard"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_bounded_loads_and_little_movement(spark, docs):
    def shards(n, balance):
        rows = ring_shards.assigned(docs, n, balance=balance).collect()
        check(rows, n, most=-(-int(1000 * (balance or 1.0001) * 1000) // (n * 1000)) + 1)
        return {r["doc_id"]: r["shard"] for r in rows}

    for balance in (None, 1.25):
        a, b = shards(8, balance), shards(9, balance)
        assert sum(a[k] != b[k] for k in a) < 0.4 * len(a)  # a plain modulus moves eight ninths


def test_nulls_empty_and_small_tables(spark):
    rows = [(None, None), (None, None), (1, ""), (1, None), (2, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ring_shards.digest(docs, 24).collect()
    check(got, 24, most=1)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert ring_shards.digest(docs.limit(0), 24).count() == 0


def test_shards_as_files(spark, docs, tmp_path):
    ring_shards.write_shards(docs, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(x["count"] for x in back.groupBy("shard").count().collect()) == [200] * 5


def test_no_python_in_the_plan(docs):
    plan = ring_shards.digest(docs, 24)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
