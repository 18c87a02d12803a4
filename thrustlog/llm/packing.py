"""Best-fit decreasing packing of tokenised documents into windows (operator 4).

A document is its ids and an end id. What exceeds whole windows is cut off first as full windows;
the rests are placed, largest first, into the open window with the least room that holds them, found
by a segment tree over remaining capacities. Rests are dealt evenly into groups of at most
``rows_per_group`` documents by their number alone, so neither copies nor a hot key gather in one
task, and a group's rows are narrow: with ``with_ids`` off they hold no tokens.

The ids are those of the vocabulary's merges; a compiled library applies them to each pre-token.

Null text is empty, a document of its end id only; null document ids and repeated rows are
documents of their own; other columns are not read. A window's number is its group's times 2^40
plus its place in the group.
"""

import heapq
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import functions as F

from thrustlog.llm.batches import text_runs
from thrustlog.llm.bpe_codec import Codec
from thrustlog.llm.byte_bpe import Remembered, shipped, vocabulary

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
GROUP_BITS = 40


class LibraryCodec(Codec):
    """Encodes as ``Codec`` does, with the merges of a pre-token left to a compiled library."""

    def __init__(self, vocab, remembered=None):
        super().__init__(vocab)
        tokens = [bytes([b]) for b in range(256)] + [vocab.token_bytes[i] for i in vocab.merged]
        ids = [*vocab.byte_ids, *vocab.merged]
        ranks = {}
        for rank, token in enumerate(tokens):
            ranks.setdefault(token, rank)
        self._ids = [i.to_bytes(4, "little") for i in ids]
        self.words = Remembered(self._word, limit=remembered or 100_000)  # cheap to make again
        self.units = Remembered(self._unit, limit=remembered) if remembered else self.units
        self._library = tiktoken.Encoding("merges", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def _word(self, word):
        return b"".join(map(self._ids.__getitem__, self._library.encode_ordinary(word)))


@lru_cache(2)
def codec(text, remembered=None):
    return LibraryCodec(vocabulary(text), remembered)


class OpenWindows:
    """Windows by remaining capacity, in a segment tree over the capacities 0 to ``size``."""

    def __init__(self, size):
        self.leaves = 1 << size.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.held = [[] for _ in range(size + 1)]

    def add(self, room, window):
        heapq.heappush(self.held[room], window)
        self._change(room, 1)

    def _change(self, room, by):
        at = room + self.leaves
        while at:
            self.counts[at] += by
            at >>= 1

    def take(self, need):
        """``(room, window)`` of the open window with the least room of at least ``need``, or None."""
        at = need + self.leaves
        while not self.counts[at]:
            while at & 1:  # a right child, or the last of its level: nothing larger below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.counts[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._change(room, -1)
        return room, heapq.heappop(self.held[room])


def best_fit(sizes, size):
    """``(window, offset)`` for each of ``sizes``, which fall; windows count from 0."""
    windows, placed, n = OpenWindows(size), [], 0
    for need in sizes:
        found = windows.take(need)
        room, window = found or (size, n)
        n += found is None
        placed.append((window, size - room))
        if room > need:
            windows.add(room - need, window)
    return placed, n


def window_rows(docs, path, size, end_id, with_ids, id_column, text_column, remembered=None):
    """Per document: its tokens, and CRC-32 (and ids, if asked for) of each of its windows."""
    shared = shipped(docs.sparkSession, path)

    def cut(batches):
        own, end = codec(shared.value, remembered), end_id.to_bytes(4, "little")
        for batch in batches:
            for start, texts in text_runs(batch, "text"):
                coded = [own.encode(text) + end for text in texts]
                windows = [[x[i : i + 4 * size] for i in range(0, len(x), 4 * size)] for x in coded]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[start : start + len(texts)],
                        pa.array([len(x) // 4 for x in coded], pa.int64()),
                        pa.array([list(map(zlib.crc32, w)) for w in windows], pa.list_(pa.int64())),
                        pa.array([w if with_ids else [] for w in windows], pa.list_(pa.binary())),
                    ],
                    names=["doc_id", "doc_tokens", "crcs", "windows"],
                )

    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, doc_tokens bigint, crcs array<bigint>, windows array<binary>")


def packed(docs, path, size=1024, end_id=0, rows_per_group=50_000, with_ids=False, id_column="doc_id", text_column="text", remembered=None):
    """One row per piece with its place; with ``with_ids`` its ids too, as little-endian unsigned 32-bit integers.

    With ids a group holds 1/25 of the documents, since its task then holds their tokens. ``remembered`` bounds the
    entries of a worker's tables of words already encoded: fewer take less memory and more time.
    """
    rows = window_rows(docs, path, size, end_id, with_ids, id_column, text_column, remembered)
    per_group = max(1, rows_per_group // 25) if with_ids else rows_per_group
    groups = max(1, math.ceil(docs.count() / per_group))

    def placed(batches):
        tables = [pa.Table.from_batches([batch]) for batch in batches if batch.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables).combine_chunks()
        tokens = table["doc_tokens"].to_numpy()
        crcs = table["crcs"].combine_chunks()
        first = crcs.offsets.to_numpy().astype(np.int64)
        crc = crcs.values.to_numpy()
        ids = table["doc_id"].combine_chunks()
        known = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
        full, rest = tokens // size, tokens % size
        order = np.lexsort((crc[first[:-1]], known, -rest))  # whatever order the rows came in
        full_first = np.empty(len(order), np.int64)
        full_first[order] = np.cumsum(full[order]) - full[order]
        open_rows = order[rest[order] > 0]
        spots, _ = best_fit(rest[open_rows].tolist(), size)
        window, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        if len(open_rows):
            window[open_rows], offset[open_rows] = np.array(spots, np.int64).T
        doc = np.repeat(np.arange(len(order)), np.diff(first))
        part = np.arange(len(doc)) - first[doc]
        whole = part < full[doc]
        base = TaskContext.get().partitionId() << GROUP_BITS
        columns = {
            "doc_id": ids.take(pa.array(doc)),
            "start": part * size,
            "length": np.where(whole, size, rest[doc]),
            "ids_crc32": crc,
            "doc_tokens": tokens[doc],
            "sequence_id": base + np.where(whole, full_first[doc] + part, full.sum() + window[doc]),
            "offset": np.where(whole, 0, offset[doc]),
        }
        if with_ids:
            columns["ids"] = table["windows"].combine_chunks().values
        yield from pa.table(columns).to_batches(max_chunksize=10_000)

    schema = PIECES + (", ids binary" if with_ids else "")
    return rows.repartition(groups).mapInArrow(placed, schema)


def sequences(pieces, size=1024, pad_id=0):
    """The packed windows themselves, from pieces with ids: at most ``size`` tokens a group, padded to ``size``."""

    def joined(batches):
        for batch in batches:
            rows = [b"".join(x["ids"] for x in sorted(row, key=lambda x: x["offset"])) for row in batch.column("pieces").to_pylist()]
            tokens = [np.frombuffer(x, "<u4").astype(np.int32) for x in rows]
            padded = [np.pad(x, (0, size - len(x)), constant_values=pad_id).tolist() for x in tokens]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array([len(x) for x in tokens], pa.int32()), pa.array(padded, pa.list_(pa.int32()))], names=["sequence_id", "used", "input_ids"])

    held = pieces.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("pieces"))
    return held.mapInArrow(joined, "sequence_id bigint, used int, input_ids array<int>")
