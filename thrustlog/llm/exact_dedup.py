"""Exact deduplication by composable polynomial fingerprints (operator 2).

A text's bytes are cut into chunks, and each chunk's polynomial hash is taken modulo the prime
2^31 - 1 for two bases. Hashes of neighbouring chunks combine by length-shifted arithmetic:
``h(xy) = h(x) * base^len(y) + h(y)``. Texts of equal fingerprint and length are then compared chunk
by chunk; where two differ, SHA-256 tells them apart.

Null counts as the empty text, and empty texts are equal. Of equal texts the row of the largest id
stays; a null id counts as the smallest; of rows alike in id and text exactly one stays. Other columns
are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from thrustlog.llm.batches import byte_runs
from thrustlog.llm.keep import bit_map, flagged, keep_rows, text_hash
from thrustlog.session import stored_table

PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)
CHUNK = 1024  # 2^31 * 2^8 * 2^10 is below 2^53, so sums of float64 products are exact
COMPARED = 1 << 16
SLICE = 1024  # chunks hashed at a time: 16 MB for the widest


class Polynomial:
    """Hashes of byte strings to the given bases; ``combine`` joins those of neighbouring parts."""

    def __init__(self, bases=BASES, prime=PRIME, chunk=CHUNK):
        self.bases, self.prime, self.chunk = bases, prime, chunk
        falling = [[pow(b, chunk - 1 - i, prime) for b in bases] for i in range(chunk)]
        self.powers = np.array(falling, np.float64)
        self.shift = [pow(b, chunk, prime) for b in bases]

    def chunks(self, texts):
        """``(text, length, hashes)`` of every chunk in turn; ``SLICE`` chunks at a time go through one matrix product.

        The matrix is as wide as the longest chunk of its slice, so neither a long text nor many short ones need much memory.
        """
        sizes = np.array([len(x) for x in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(sizes)
        parts = -(-sizes // self.chunk)
        first = np.cumsum(parts) - parts
        for low in range(0, int(parts.sum()), SLICE):
            place = np.arange(low, min(low + SLICE, int(parts.sum())))
            text = np.searchsorted(first, place, side="right") - 1
            start = (ends - sizes)[text] + (place - first[text]) * self.chunk
            stop = np.minimum(start + self.chunk, ends[text])
            width = int((stop - start).max())
            at = stop[:, None] - width + np.arange(width)  # leading zeros leave a hash as it is
            values = np.where(at >= start[:, None], data[np.maximum(at, 0)], 0).astype(np.float64)
            yield text, stop - start, np.mod(values @ self.powers[self.chunk - width :], self.prime).astype(np.int64)

    def combine(self, left, right, right_length):
        """Hash of two neighbouring parts from theirs and the length of the second."""
        shifts = self.shift if right_length == self.chunk else [pow(b, int(right_length), self.prime) for b in self.bases]
        return [(x * s + y) % self.prime for x, s, y in zip(left, shifts, right, strict=True)]

    def fingerprints(self, texts):
        found = [[0] * len(self.bases) for _ in texts]
        for slice in self.chunks(texts):
            for text, length, hashes in zip(*(x.tolist() for x in slice), strict=True):
                found[text] = self.combine(found[text], hashes, length)
        bits = self.prime.bit_length()
        return [sum(h << bits * i for i, h in enumerate(x)) for x in found]


def fingerprinted(docs, polynomial, id_column="doc_id", text_column="text"):
    """Per document its fingerprint, bytes, SHA-256, and a hash that names the row again."""

    def read(batches):
        for batch in batches:
            for start, texts in byte_runs(batch, "text"):
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id"), own.column("text_hash"), pa.array(polynomial.fingerprints(texts), pa.int64()),
                        pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                    ],
                    names=["doc_id", "text_hash", "print", "n_bytes", "text_sha256"],
                )

    text = docs[text_column].cast("string")
    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), text.alias("text"), text_hash(text).alias("text_hash"))
    return rows.mapInArrow(read, "doc_id bigint, text_hash bigint, print bigint, n_bytes bigint, text_sha256 string")


def collided(docs, prints, polynomial, text_column="text"):
    """Fingerprints and lengths that texts of different bytes share, found by comparing chunk by chunk.

    Equal chunks meet in a count per map task before they move, so a large group of copies moves one
    copy per task. Only texts whose fingerprint may occur twice are cut into chunks at all.
    """
    twice = prints.groupBy("print", "n_bytes").agg(F.count("*").alias("n")).where("n > 1")
    bits = bit_map(twice.select("print"))

    def hashed(batches):
        for batch in batches:
            for start, texts in byte_runs(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(polynomial.fingerprints(texts), pa.int64()), batch.column("text").slice(start, len(texts))], names=["print", "text"]
                )

    def cut(batches):
        for batch in batches:
            prints = batch.column("print").to_pylist()
            for start, texts in byte_runs(batch, "text"):
                rows = [(prints[start + i], len(x), k, x[k : k + COMPARED]) for i, x in enumerate(texts) for k in range(0, len(x), COMPARED)]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["print", "n_bytes", "at", "chunk"])

    texts = docs.select(F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text")).mapInArrow(hashed, "print bigint, text string")
    doubtful = flagged(texts, F.col("print"), bits).where("_may").select("print", "text")
    chunks = doubtful.mapInArrow(cut, "print bigint, n_bytes bigint, at bigint, chunk binary")
    different = chunks.groupBy("print", "n_bytes", "at", "chunk").agg(F.lit(1).alias("one")).groupBy("print", "n_bytes", "at").agg(F.count("*").alias("n"))
    return different.where("n > 1").select("print", "n_bytes").distinct()


def decided(docs, polynomial=None, id_column="doc_id", text_column="text"):
    """One row per document: what stays for it, how many texts equal it, and whether it stays itself."""
    polynomial = polynomial or Polynomial()
    named = fingerprinted(docs, polynomial, id_column, text_column).withColumn("uid", F.monotonically_increasing_id())
    prints = stored_table(named, "prints")
    apart = collided(docs, prints, polynomial, text_column).withColumn("apart", F.lit(True))
    # copies meet per map task before they move; what is left has one row per text
    texts = prints.groupBy("print", "n_bytes", "text_sha256").agg(F.max(F.struct("doc_id", "uid")).alias("last"), F.count("*").alias("n"))
    split = F.when(F.col("apart"), F.col("text_sha256")).otherwise("")
    equal = Window.partitionBy("print", "n_bytes", split)
    groups = texts.join(apart, ["print", "n_bytes"], "left").select(
        "print", "n_bytes", "text_sha256", F.max("last").over(equal).alias("last"), F.sum("n").over(equal).alias("group_size")
    )
    return prints.join(groups, ["print", "n_bytes", "text_sha256"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("last.uid")).alias("kept"), "text_sha256", "text_hash"
    )


def deduplicated(docs, polynomial=None, id_column="doc_id", text_column="text"):
    """The documents that stay, with their own columns."""
    verdicts = stored_table(decided(docs, polynomial, id_column, text_column).where("group_size > 1"), "copies")
    return keep_rows(docs, verdicts.select("doc_id", "text_hash", F.col("kept").alias("keep")), id_column, text_column)
