"""Leaving out rows by a verdict table without moving the texts of the others.

The keys of rows that a verdict names set bits of a map of fixed size, which is broadcast; only rows whose bit
is set meet the verdict table in a join. A full map costs more moving, never a wrong row.
"""

from pyspark.sql import functions as F

WORDS = 1 << 18  # of 64 bits: at most 4 MB of (place, bits) rows


def bit_map(keys, words=WORDS):
    """Rows (place, bits) from one bigint column of hashes; at most ``words`` rows."""
    (name,) = keys.columns
    key = F.col(name)
    return keys.groupBy(F.pmod(key, F.lit(words)).alias("place")).agg(
        F.expr(f"bit_or(shiftleft(1L, CAST(pmod(shiftright(`{name}`, 32), 64) AS INT)))").alias("bits")
    )


def flagged(rows, key, bits, words=WORDS):
    """``rows`` with boolean ``_may``: false where the key is certainly none of the map's."""
    named = rows.withColumn("_key", key).withColumn("place", F.pmod("_key", F.lit(words)))
    bit = F.expr("(shiftright(bits, CAST(pmod(shiftright(_key, 32), 64) AS INT)) & 1L) = 1L")
    found = named.join(F.broadcast(bits), "place", "left")
    return found.withColumn("_may", F.coalesce(bit, F.lit(False))).drop("place", "bits", "_key")


def text_hash(column):
    return F.xxhash64(F.coalesce(column.cast("string"), F.lit("")))


def keep_rows(docs, verdicts, id_column="doc_id", text_column="text"):
    """``docs`` without the rows that ``verdicts`` (doc_id, text_hash, keep) reject.

    A row without a verdict stays. Of rows alike in id and text whose verdict is to keep, one stays.
    """
    packed = docs.select(
        F.struct("*").alias("row"), docs[id_column].cast("bigint").alias("doc_id"), text_hash(docs[text_column]).alias("text_hash")
    )
    key = F.xxhash64("doc_id", "text_hash")
    marked = flagged(packed, key, bit_map(verdicts.select(key.alias("key"))))
    sure = marked.where(~F.col("_may")).select("row.*")
    named = verdicts.groupBy("doc_id", "text_hash").agg(F.max("keep").alias("keep"), F.lit(True).alias("judged"))
    open_rows = marked.where("_may").alias("l")
    met = open_rows.join(
        named.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")), "left"
    ).select("l.row", "l.doc_id", "l.text_hash", "keep", "judged")
    spared = met.where("judged IS NULL").select("row.*")
    stay = met.where("judged AND keep").dropDuplicates(["doc_id", "text_hash"]).select("row.*")
    return sure.unionByName(spared).unionByName(stay)
