"""SimHash near-duplicates by a hierarchical index in Gray order (operator 6).

Fingerprints: A-Z in lower case, words, shingles of words (a shorter text is one shingle), XXH64 of each with seed
42; a bit is set if more than half of the hashes have it. A text without words has fingerprint zero.

Links: distinct fingerprints are dealt by blocks of their bits, so that two within the distance agree in one
block at least. In each group the fingerprints are sorted by Gray rank and an index is built over them: an
upper node holds the bits that all below it share and that no node above holds. A search goes down with
the differences added up and leaves a node as soon as they exceed the distance; it also leaves a node
that lies in the searcher's own component, so a crowd of near copies is not paired out. A group
gives each member's component within the group, one row per member at most; the components of all
documents follow from these.

Null texts have no words. A null id takes part but is never a component's name unless no member has an id.
Repeated rows link like copies. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from thrustlog.llm.batches import byte_runs
from thrustlog.llm.components import components
from thrustlog.llm.keep import keep_rows, text_hash
from thrustlog.session import stored_table

BITS = 64
SEED = 42
FANOUT = 8
FRONTIER = 1 << 20
GROUP = 4096

LANES = np.array([int.from_bytes(bytes((b >> i) & 1 for i in range(8)), "little") for b in range(256)], np.uint64)


def shingle_hashes(text, width):
    words = text.lower().split()  # of bytes: A-Z, and the six white space bytes of ASCII
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    parts = [words[i:] for i in range(width)]
    return [xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*parts, strict=False))]


def fingerprints(texts, width):
    """Signed 64-bit fingerprints of texts given as bytes."""
    hashes = [shingle_hashes(x, width) for x in texts]
    n = np.array([len(x) for x in hashes], np.int64)
    found = np.zeros(len(texts), np.uint64)
    if not n.sum():
        return found.view(np.int64)
    flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(n.sum()))
    owner = np.repeat(np.arange(len(texts)), n)
    # each of the 8 bytes becomes 8 counters of a byte; at most 255 rows are added at a time
    first = np.concatenate([np.arange(s, s + k, 255) for s, k in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True) if k])
    lanes = np.add.reduceat(LANES[flat.view(np.uint8).reshape(-1, 8)], first, axis=0)
    counts = lanes.view(np.uint8).reshape(len(first), BITS).astype(np.int64)
    text, start = np.unique(owner[first], return_index=True)
    total = np.add.reduceat(counts, start, axis=0)
    bits = 2 * total > n[text][:, None]
    found[text] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return found.view(np.int64)


def gray_rank(values):
    """Place of each value in the order of the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; ``levels[0]`` are the fingerprints themselves."""

    def __init__(self, values):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        patterns, masks = [self.values], [np.full(len(values), ~np.uint64(0))]
        while len(patterns[-1]) > FANOUT:
            starts = np.arange(0, len(patterns[-1]), FANOUT)
            first = patterns[-1][starts]
            differ = patterns[-1] ^ np.repeat(first, np.diff(np.append(starts, len(patterns[-1]))))
            masks.append(np.bitwise_and.reduceat(masks[-1] & ~differ, starts))
            patterns.append(first & masks[-1])
        self.patterns, self.own = patterns, []
        for level, mask in enumerate(masks):
            above = masks[level + 1][np.arange(len(mask)) // FANOUT] if level + 1 < len(masks) else np.uint64(0)
            self.own.append(mask & ~above)

    def _shared(self, labels):
        """Per level and node: the label that all fingerprints below share, or -1."""
        levels = [labels]
        for level in range(1, len(self.patterns)):
            starts = np.arange(0, len(levels[-1]), FANOUT)
            low, high = np.minimum.reduceat(levels[-1], starts), np.maximum.reduceat(levels[-1], starts)
            levels.append(np.where(low == high, low, -1))
        return levels

    def components(self, distance):
        """For each of ``values`` the least place of its component."""
        n = len(self.values)
        labels = np.arange(n)
        near = np.bitwise_count(self.values[1:] ^ self.values[:-1]) <= distance
        labels = np.flatnonzero(np.concatenate([[True], ~near]))[np.cumsum(np.concatenate([[0], ~near]))] if n else labels
        start, step = 0, 16
        while start < n:
            stop = min(n, start + step)
            pairs = self._search(np.arange(start, stop), self._shared(labels), distance)
            labels = self._joined(labels, pairs)
            start, step = stop, min(2 * step, 1024)
        return labels

    @staticmethod
    def _joined(labels, pairs):
        if not pairs:
            return labels
        root = {}

        def find(x):
            while x in root:
                x = root[x]
            return x

        for a, b in np.unique(np.concatenate(pairs), axis=0).tolist():
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if root:
            moved = np.array(sorted(root))
            to = np.array([find(x) for x in moved.tolist()])
            at = np.minimum(np.searchsorted(moved, labels), len(moved) - 1)
            labels = np.where(moved[at] == labels, to[at], labels)
        return labels

    def _search(self, queries, shared, distance):
        """Pairs of labels that a link joins, for the fingerprints at ``queries`` against all later ones."""
        labels, found = shared[0], []
        top = len(self.patterns) - 1
        nodes = np.arange(len(self.patterns[top]))
        stack = [(top, np.repeat(queries, len(nodes)), np.tile(nodes, len(queries)), np.zeros(len(queries) * len(nodes), np.uint8))]
        while stack:
            level, query, node, differences = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(level, query[:half], node[:half], differences[:half]), (level, query[half:], node[half:], differences[half:])]
                continue
            differences = differences + np.bitwise_count((self.values[query] ^ self.patterns[level][node]) & self.own[level][node])
            open_ = (differences <= distance) & (shared[level][node] != labels[query])
            open_ &= (node + 1) * FANOUT**level > query  # nothing later below
            query, node, differences = query[open_], node[open_], differences[open_]
            if not len(query):
                continue
            if level == 0:
                found.append(np.unique(np.stack([labels[query], labels[node]], axis=1), axis=0))
                continue
            children = len(self.patterns[level - 1])
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            inside = node < children
            stack.append((level - 1, np.repeat(query, FANOUT)[inside], node[inside], np.repeat(differences, FANOUT)[inside]))
        return found


def blocks(distance, distinct, group=GROUP):
    """Masks of the blocks: ``distance + 1`` of them, each of as many bits as leave about ``group`` fingerprints together."""
    n = distance + 1
    edges = [BITS * i // n for i in range(n + 1)]
    width = min(max(0, (distinct // group).bit_length()), BITS // n)
    return [((1 << min(width, b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def _signed(mask):
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprinted(docs, width=4, id_column="doc_id", text_column="text"):
    """Per document its fingerprint, and a hash that names the row again."""

    def read(batches):
        for batch in batches:
            for start, texts in byte_runs(batch, "text"):
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_hash"), pa.array(fingerprints(texts, width))], names=["doc_id", "text_hash", "print"])

    text = docs[text_column].cast("string")
    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), text.alias("text"), text_hash(text).alias("text_hash"))
    return rows.mapInArrow(read, "doc_id bigint, text_hash bigint, print bigint")


def linked(prints, distance=4):
    """``prints`` holds distinct fingerprints; returns (print, root) for all that have another within reach."""
    masks = blocks(distance, prints.count())
    partitions = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = F.array(*(F.struct(F.lit(i).alias("block"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)))
    dealt = prints.select("print", F.explode(keys).alias("key")).select("print", "key.*").repartition(partitions, "block", "bits")

    def joined(table):
        index = GrayIndex(table["print"].to_numpy().view(np.uint64))
        labels = index.components(distance)
        values = index.values.view(np.int64)
        other = labels != np.arange(len(labels))
        return pa.table({"u": values[other], "v": values[labels[other]]})

    return components(dealt.groupBy("block", "bits").applyInArrow(joined, "u bigint, v bigint"))


def grouped(docs, width=4, distance=4, id_column="doc_id", text_column="text"):
    """Per document: its fingerprint and the least id of its component."""
    rows = stored_table(fingerprinted(docs, width, id_column, text_column), "simhash")
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = linked(stored_table(prints.select("print"), "simhash-distinct"), distance)
    named = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = stored_table(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("print", "root", "component_id")
    return rows.join(by_print, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_hash"
    )


def deduplicated(docs, width=4, distance=4, id_column="doc_id", text_column="text"):
    """One document of each component: that of the least id. Rows alike in id and text count as one."""
    found = stored_table(grouped(docs, width, distance, id_column, text_column), "simhash-groups")
    # the kept row of a component: least id, null last, then least text hash
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    crowded = found.groupBy("root").agg(first, F.count("*").alias("n")).where("n > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    verdicts = found.join(crowded, "root").select("doc_id", "text_hash", stays.alias("keep"))
    return keep_rows(docs, stored_table(verdicts, "simhash-verdicts"), id_column, text_column)
