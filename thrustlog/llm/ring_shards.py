"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (operator 5).

The ring has ``spots`` places. Every shard stands at ``nodes`` of them; a key belongs to the first
node clockwise from its spot. No shard takes more than its bound: its own keys come first, in ring
order, and the keys beyond the bound go on clockwise, first come first served, to the next node
whose shard has room. With ``balance=None`` the bounds add up to the number of rows, so the row counts of
shards differ by one at most; ``balance=1.1`` lets a shard hold a tenth above the mean, and moves fewer keys
when shards are added.

Only built-in functions run. The rows are counted by (spot, salt) before any shuffle; the ring itself has
``shards * nodes`` nodes and ``spots`` spots, whatever the rows. A row's rank within its spot is taken
per salt, a share of the input's partitions, so that a hot key is cut up into ``salts`` groups even where its rows
are alike. The rows are stored with their salts first: counts and ranks read the same salts, however the input is made.

Null ids and texts hash like any other value. Rows alike in id and text are interchangeable; each gets its
own place. Columns named as those added are replaced; an empty table gives no rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from thrustlog.session import stored_table

ADDED = ["shard", "slot"]
ROWS_PER_SALT = 3_000_000


def ring(spark, shards, nodes, spots):
    """The nodes in ring order, and for every spot the node that owns it."""
    hashed = spark.range(shards * nodes).select(
        (F.col("id") / nodes).cast("int").alias("shard"), F.xxhash64((F.col("id") / nodes).cast("int"), F.col("id") % nodes).alias("h"),
    )
    place = hashed.select("shard", "h", F.pmod("h", F.lit(spots)).cast("int").alias("spot"))
    order = Window.orderBy("spot", "h", "shard")
    placed = place.select("shard", "spot", (F.row_number().over(order) - 1).alias("node"))
    first = placed.groupBy("spot").agg(F.min("node").alias("node"))
    clockwise = Window.orderBy("spot").rowsBetween(0, Window.unboundedFollowing)
    all_spots = spark.range(spots).select(F.col("id").cast("int").alias("spot")).join(first, "spot", "left")
    owner = F.coalesce(F.first("node", ignorenulls=True).over(clockwise), F.lit(0))
    owned = all_spots.select("spot", owner.alias("node")).join(placed.select("node", "shard"), "node")
    return placed.select("node", "shard"), owned


def bounds(rows, shards, balance):
    """Column array: the most rows of each shard."""
    if balance is None:
        return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.lit(rows // shards).cast("bigint") + F.when(s < rows % shards, 1).otherwise(0))
    most = -(-int(rows * balance * 1_000_000) // (shards * 1_000_000))
    return F.array_repeat(F.lit(max(most, -(-rows // shards))).cast("bigint"), shards)


def _overflow(spots, nodes, shards, bound):
    """One row: the stretches of the queue of overflowing keys, with the shard and slots that take them."""
    free = spots.groupBy("shard").agg(F.sum("taken").alias("taken")).groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct("shard", "taken"))).alias("taken")
    )
    arrivals = spots.groupBy("node").agg(F.sum("over").alias("over"))
    walk = nodes.join(arrivals, "node", "left").groupBy().agg(
        F.sort_array(F.collect_list(F.struct("node", "shard", F.coalesce("over", F.lit(0)).alias("over")))).alias("walk")
    )
    one = walk.withColumn("one", F.lit(1)).join(free.withColumn("one", F.lit(1)), "one")
    held = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.element_at("taken", s), F.lit(0)).cast("bigint"))
    laps = F.concat("walk", F.transform("walk", lambda x: F.struct(x["node"].alias("node"), x["shard"].alias("shard"), F.lit(0).cast("bigint").alias("over"))))
    start = one.select(laps.alias("laps"), held.alias("held"), bound.alias("bound"))
    none = F.array().cast("array<struct<start:bigint,n:bigint,shard:int,slot:bigint>>")
    zero = F.struct(F.col("held").alias("held"), F.lit(0).cast("bigint").alias("carry"), F.lit(0).cast("bigint").alias("done"), none.alias("found"))

    def step(state, node):
        n = F.least(F.get("bound", node["shard"]) - F.get(state["held"], node["shard"]), state["carry"])
        return F.transform(F.array(n), lambda n: F.struct(
            F.transform(state["held"], lambda x, s: F.when(s == node["shard"], x + n).otherwise(x)).alias("held"),
            (state["carry"] - n + node["over"]).alias("carry"),
            (state["done"] + n).alias("done"),
            F.when(n > 0, F.concat(state["found"], F.array(F.struct(
                state["done"].alias("start"), n.alias("n"), node["shard"].alias("shard"), F.get(state["held"], node["shard"]).alias("slot"),
            )))).otherwise(state["found"]).alias("found"),
        ))[0]

    return start.select(F.aggregate("laps", zero, step, lambda state: state["found"]).alias("stretches"))


def plan(cells, spark, rows, shards, nodes=64, spots=8192, balance=None):
    """For every spot: its shard, how many of its keys stay there and from which slot on, and where the others go."""
    ring_nodes, owned = ring(spark, shards, nodes, spots)
    bound = bounds(rows, shards, balance)
    counts = owned.join(cells.groupBy("spot").agg(F.sum("n").alias("n")), "spot", "left").select(
        "spot", "node", "shard", F.coalesce("n", F.lit(0)).alias("n")
    )
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("spot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    room = F.greatest(F.get(bound, F.col("shard")) - before, F.lit(0))
    homes = counts.select("spot", "node", "shard", "n", before.alias("first"), F.least(room, F.col("n")).alias("taken"))
    homes = homes.withColumn("over", F.col("n") - F.col("taken"))
    queue = F.sum("over").over(Window.orderBy("node", "spot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("over")
    stretches = _overflow(homes, ring_nodes, shards, bound).withColumn("one", F.lit(1))
    queued = homes.withColumn("queued", queue).withColumn("one", F.lit(1)).join(F.broadcast(stretches), "one")
    own = F.filter("stretches", lambda x: (x["start"] < F.col("queued") + F.col("over")) & (x["start"] + x["n"] > F.col("queued")))
    return queued.select("spot", "shard", "first", "taken", "queued", F.when(F.col("over") > 0, own).alias("stretches"))


def assigned(docs, shards, balance=None, nodes=64, spots=8192, id_column="doc_id", text_column="text"):
    """``docs`` with ``shard``, 0 to ``shards - 1``, and ``slot``, gapless from 0 in each shard."""
    spark = docs.sparkSession
    kept = [docs[c] for c in docs.columns if c not in ADDED]
    text = docs[text_column].cast("string")
    keyed = docs.select(
        F.struct(*kept).alias("row"),
        F.xxhash64(docs[id_column], text).alias("tie"),
        F.pmod(F.xxhash64(docs[id_column]), F.lit(spots)).cast("int").alias("spot"),
        F.spark_partition_id().alias("part"),
    )
    keyed = stored_table(keyed, "ring-rows")
    rows = keyed.count()
    keyed = keyed.withColumn("salt", F.pmod("part", F.lit(max(8, rows // ROWS_PER_SALT))))
    cells = keyed.groupBy("spot", "salt").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("spot").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    cells_first = cells.select("spot", "salt", first.alias("cell_first"))
    spots_plan = plan(cells, spark, rows, shards, nodes, spots, balance)
    rank = F.row_number().over(Window.partitionBy("spot", "salt").orderBy("tie")) - 1
    ranked = keyed.withColumn("rank", rank).join(cells_first, ["spot", "salt"]).withColumn("rank", F.col("rank") + F.col("cell_first"))
    # one row per spot, a number fixed by the parameter ``spots``
    found = ranked.join(F.broadcast(spots_plan), "spot")
    at = F.col("queued") + F.col("rank") - F.col("taken")
    stretch = F.filter("stretches", lambda x: (x["start"] <= F.col("at")) & (F.col("at") < x["start"] + x["n"]))[0]
    home = F.col("rank") < F.col("taken")
    placed = found.withColumn("at", at).withColumn("stretch", F.when(~home, stretch))
    return placed.select(
        "row.*",
        F.when(home, F.col("shard")).otherwise(F.col("stretch.shard")).cast("int").alias("shard"),
        F.when(home, F.col("first") + F.col("rank")).otherwise(F.col("stretch.slot") + F.col("at") - F.col("stretch.start")).cast("bigint").alias("slot"),
    )


def write_shards(docs, folder, shards, **settings):
    """Write each shard's documents to a folder of its own, ``shard=0`` and so on, as Parquet."""
    placed = assigned(docs, shards, **settings)
    placed.write.partitionBy("shard").parquet(folder)


def digest(docs, shards, id_column="doc_id", text_column="text", **settings):
    """Places with size and CRC-32 of the text in its stead."""
    text = docs[text_column].cast("string")
    narrow = docs.select(
        docs[id_column].cast("bigint").alias("doc_id"), text.alias("text"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    hashed = narrow.select("doc_id", "size", "text_crc32", F.xxhash64("text").alias("text_hash"))
    placed = assigned(hashed, shards, text_column="text_hash", **settings)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
