"""Fill-in-the-middle transformation over a boundary set of containers (operator 13).

Tokens are runs of ASCII letters and single other code points. A boundary is the offset, in code points, where a
token ends. The boundaries of a text form a compressed set: one container for each 65,536 offsets, held as a sorted array, a
bitmap or runs, whichever is smallest, and the cumulative cardinalities. The k-th boundary is found by a search
for its container and a selection inside; two selections give both cuts. Python returns only the two offsets; Spark
cuts and joins the text, and takes it apart again.

Null text is empty and stays plain, as does a text that holds one of the marks. A null id hashes like an empty one. Ties and
repeated rows are transformed row by row; other columns pass through unchanged, and those named like a result are replaced; an
empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from thrustlog.llm.batches import text_runs

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
PLAIN_FROM, SUFFIX_FIRST = 90, 20  # of a hundred
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
BITS = 16
ARRAY_MOST = 4096
CUTS = StructType([StructField(name, LongType()) for name in ("n", "low", "high")])
_BIT_COUNTS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


class ArrayContainer:
    def __init__(self, offsets):
        self.offsets, self.size = offsets.astype(np.uint16), len(offsets)

    def select(self, k):
        return int(self.offsets[k])


class BitmapContainer:
    def __init__(self, flags):
        self.bits = np.packbits(flags)
        self.counts = np.cumsum(_BIT_COUNTS[self.bits])
        self.size = int(self.counts[-1])

    def select(self, k):
        byte = int(np.searchsorted(self.counts, k, side="right"))
        before = int(self.counts[byte - 1]) if byte else 0
        return 8 * byte + int(np.flatnonzero(np.unpackbits(self.bits[byte : byte + 1]))[k - before])


class RunContainer:
    def __init__(self, starts, lengths):
        self.starts, self.counts = starts.astype(np.uint16), np.cumsum(lengths)
        self.size = int(self.counts[-1])

    def select(self, k):
        run = int(np.searchsorted(self.counts, k, side="right"))
        return int(self.starts[run]) + k - (int(self.counts[run - 1]) if run else 0)


def container(flags):
    """The smallest container of the places that are set, of which there is at least one."""
    offsets = np.flatnonzero(flags)
    breaks = np.flatnonzero(np.diff(offsets) != 1) + 1
    if 4 * (len(breaks) + 1) < min(2 * len(offsets), len(flags) // 8 or 1):
        edges = np.concatenate(([0], breaks, [len(offsets)]))
        return RunContainer(offsets[edges[:-1]], np.diff(edges))
    return ArrayContainer(offsets) if len(offsets) <= ARRAY_MOST else BitmapContainer(flags)


def letters(part):
    codes = np.frombuffer(part.encode("utf-32-le"), "<u4")
    low = codes | 32
    return (low >= 97) & (low <= 122) & (codes < 128)


class BoundarySet:
    """Offsets at which the tokens of a text end."""

    def __init__(self, text):
        self.keys, self.containers, sizes = [], [], []
        width = 1 << BITS
        # container j holds the ends 65,536 j + 1 to 65,536 (j + 1), each less one: the last code point of its token
        for key, start in enumerate(range(0, len(text), width)):
            own = letters(text[start : start + width + 1])
            n = min(width, len(text) - start)
            joined = own[:-1] & own[1:]  # the token goes on behind this code point
            flags = ~(joined if len(own) > n else np.append(joined, False))
            if flags.any():
                self.keys.append(key)
                self.containers.append(container(flags))
                sizes.append(self.containers[-1].size)
        self.counts = np.cumsum(sizes, dtype=np.int64)

    def __len__(self):
        return int(self.counts[-1]) if len(self.counts) else 0

    def end(self, k):
        """The offset where the first ``k`` tokens end."""
        if k == 0:
            return 0
        place = int(np.searchsorted(self.counts, k - 1, side="right"))
        before = int(self.counts[place - 1]) if place else 0
        return (self.keys[place] << BITS) + self.containers[place].select(k - 1 - before) + 1


def cuts(text, first, second):
    """Number of tokens, and the two cuts that the draws give, as offsets in code points."""
    ends = BoundarySet(text)
    n = len(ends)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, ends.end(low), ends.end(high)


@F.arrow_udf(CUTS)
def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([text], names=["text"])
    draws = zip(first.to_pylist(), second.to_pylist(), strict=True)
    found = [cuts(t, *next(draws)) for _, texts in text_runs(batch, "text") for t in texts]
    columns = zip(*found, strict=True) if found else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["n", "low", "high"])


def transformed(docs, seed="1", id_column="doc_id", text_column="text"):
    """``docs`` with the number of tokens, the form, the lengths of prefix and middle, and the output text."""
    kept = [docs[c] for c in docs.columns if c not in ADDED]
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_column].cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    drawn = docs.select(F.struct(*kept).alias("row"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"), *[d.alias(f"h{i + 1}") for i, d in enumerate(draws)])
    plain = (F.col("text") == "") | F.col("text").rlike(MARKS) | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    cut = drawn.select("row", "text", form.alias("form"), _cuts("text", "h1", "h2").alias("cut"))

    def part(start, length):
        return F.substring("text", start.cast("int"), length.cast("int"))

    low, high = F.col("cut.low"), F.col("cut.high")
    prefix = F.concat(F.lit(PREFIX), part(F.lit(1), low))
    suffix = F.concat(F.lit(SUFFIX), part(high + 1, F.char_length("text")))
    middle = F.concat(F.lit(MIDDLE), part(low + 1, high - low))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).otherwise(F.concat(suffix, prefix, middle))
    told = F.col("form") != "plain"
    return cut.select(
        "row.*", F.col("cut.n").alias("n"), "form", F.when(told, low).alias("prefix_chars"), F.when(told, high - low).alias("middle_chars"), output.alias("output"),
    )


def restored(output, form):
    """Column: the exact text, from an output and its form."""
    parts = F.split(output, MARKS)
    psm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
    spm = F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs, **settings):
    """Per document: id, tokens, form, lengths, and SHA-256 of the output and of the text restored from it."""
    found = transformed(docs.select("doc_id", "text"), **settings)
    rebuilt = restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(rebuilt.cast("binary"), 256).alias("restored_sha256"),
    )
