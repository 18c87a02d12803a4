"""BPE encoding and decoding (operator 7).

Encoding keeps a priority queue of merge ranks over a doubly linked list of symbols and skips stale
entries; decoding concatenates vocabulary strings. Null and empty texts have no ids and decode to
the empty text; null document ids and repeated rows pass through row by row; other columns are not
read. Ids are held as little-endian unsigned 32-bit integers.
"""

import hashlib
import heapq
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from thrustlog.llm.batches import text_runs
from thrustlog.llm.byte_bpe import SHIFT, Remembered, shipped, units, vocabulary

DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
CODE_SCHEMA = "doc_id bigint, ids array<int>, decoded string"


def merged_ids(ids, vocab):
    """Ids of a pre-token from the ids of its bytes. Changes ``ids``."""
    n, ranks = len(ids), vocab.ranks
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the linked list
    queue = [(ranks[pair], i) for i in range(n - 1) if (pair := ids[i] << SHIFT | ids[i + 1]) in ranks]
    heapq.heapify(queue)
    while queue:
        rank, i = heapq.heappop(queue)
        j = after[i]
        if ids[i] is None or j >= n or ranks.get(ids[i] << SHIFT | ids[j]) != rank:
            continue  # stale
        ids[i], ids[j] = vocab.merged[rank], None
        h = before[i]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (pair := ids[i] << SHIFT | ids[k]) in ranks:
                heapq.heappush(queue, (ranks[pair], i))
        if h >= 0 and (pair := ids[h] << SHIFT | ids[i]) in ranks:
            heapq.heappush(queue, (ranks[pair], h))
    return [id for id in ids if id is not None]


class Codec:
    """Encodes and decodes whole texts with one vocabulary."""

    def __init__(self, vocab):
        self.vocab = vocab
        self.words = Remembered(self._word)
        self.units = Remembered(self._unit)

    def _word(self, word):
        ids = self.vocab.byte_ids
        found = merged_ids([ids[b] for b in word.encode()], self.vocab)
        return struct.pack(f"<{len(found)}I", *found)

    def _unit(self, unit):
        return b"".join(map(self.words.__getitem__, self.vocab.unit_pretokens(unit)))

    def _plain(self, text):
        return b"".join(map(self.words.__getitem__, self.vocab.pretokens(text)))

    def encode(self, text):
        """Ids as the bytes of little-endian unsigned 32-bit integers."""
        found = []
        for part, special in self.vocab.plain_parts(text):
            if part:
                first, rest = units(part)
                found.append(self._plain(first))
                found.extend(map(self.units.__getitem__, rest))
            if special is not None:
                found.append(special.to_bytes(4, "little"))
        return b"".join(found)

    def decode(self, ids):
        """The text's bytes of ids in the form that ``encode`` gives."""
        words = array("I")
        words.frombytes(ids)
        text = b"".join(map(self.vocab.token_bytes.__getitem__, words))
        return text.decode("utf-8", "replace").encode()


@lru_cache(2)
def codec(text):
    return Codec(vocabulary(text))


def _mapped(docs, path, id_column, text_column, schema, columns):
    shared = shipped(docs.sparkSession, path)

    def mapped(batches):
        own = codec(shared.value)
        for batch in batches:
            for start, texts in text_runs(batch, "text"):
                ids = batch.column("doc_id")[start : start + len(texts)]
                yield pa.RecordBatch.from_arrays([ids, *columns[1](own, texts)], names=["doc_id", *columns[0]])

    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(mapped, schema)


def code_digests(docs, path, id_column="doc_id", text_column="text"):
    """Number and SHA-256 of every text's ids, and SHA-256 of the text decoded from them."""

    def columns(own, texts):
        coded = list(map(own.encode, texts))
        return [
            pa.array([len(x) // 4 for x in coded], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
            pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in coded], pa.string()),
        ]

    return _mapped(docs, path, id_column, text_column, DIGEST_SCHEMA, (["n_tokens", "ids_sha256", "decoded_sha256"], columns))


def encoded(docs, path, id_column="doc_id", text_column="text"):
    """The ids of every text as an array, and the text decoded from them."""

    def columns(own, texts):
        coded = list(map(own.encode, texts))
        ends = np.cumsum([0, *(len(x) // 4 for x in coded)])
        flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array([own.decode(x).decode() for x in coded], pa.string())]

    return _mapped(docs, path, id_column, text_column, CODE_SCHEMA, (["ids", "decoded"], columns))
