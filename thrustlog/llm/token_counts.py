"""Token counts by heap-and-linked-list byte-pair merging (operator 3).

The adjacent pair of lowest rank is popped from a heap again and again; a count is the number of
initial symbols less the number of merges, and no token id is made. Null and empty texts count 0,
null ids and repeated rows pass through row by row, other columns are not read. Counts of units and
pre-tokens are remembered in tables of bounded size, per worker.
"""

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa

from thrustlog.llm.batches import byte_lengths, text_runs
from thrustlog.llm.byte_bpe import SHIFT, Remembered, shipped, units, vocabulary

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
POSITION = 40
MASK = (1 << POSITION) - 1


def symbols_left(symbols, ranks, merged):
    """How many symbols remain once no adjacent pair has a rank. Changes ``symbols``."""
    n = len(symbols)
    pairs = [ranks.get(symbols[i] << SHIFT | symbols[i + 1], -1) for i in range(n - 1)]
    pairs.append(-1)  # rank of the pair that begins at each place, -1 for none
    heap = [rank << POSITION | i for i, rank in enumerate(pairs) if rank >= 0]
    heapify(heap)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        top = heappop(heap)
        rank, i = top >> POSITION, top & MASK
        if pairs[i] != rank:
            continue  # stale: a neighbour was merged since
        j = after[i]
        symbols[i] = symbol = merged[rank]
        pairs[j] = -1
        left -= 1
        after[i] = k = after[j]
        pairs[i] = -1
        if k < n:
            before[k] = i
            rank = ranks.get(symbol << SHIFT | symbols[k], -1)
            if rank >= 0:
                pairs[i] = rank
                heappush(heap, rank << POSITION | i)
        h = before[i]
        if h >= 0:
            pairs[h] = rank = ranks.get(symbols[h] << SHIFT | symbol, -1)
            if rank >= 0:
                heappush(heap, rank << POSITION | h)
    return left


class Counter:
    """Counts the tokens of texts with one vocabulary."""

    def __init__(self, vocab):
        self.vocab = vocab
        self.words = Remembered(self._word)
        self.units = Remembered(self._unit)

    def _word(self, word):
        ids = self.vocab.byte_ids
        return symbols_left([ids[b] for b in word.encode()], self.vocab.ranks, self.vocab.merged)

    def _unit(self, unit):
        return sum(map(self.words.__getitem__, self.vocab.unit_pretokens(unit)))

    def _plain(self, text):
        return sum(map(self.words.__getitem__, self.vocab.pretokens(text)))

    def count(self, text):
        total = 0
        for part, special in self.vocab.plain_parts(text):
            if part:
                first, rest = units(part)
                total += self._plain(first) + sum(map(self.units.__getitem__, rest))
            total += special is not None
        return total


@lru_cache(2)
def counter(text):
    return Counter(vocabulary(text))


def token_counts(docs, path, limit=512, id_column="doc_id", text_column="text"):
    """Bytes and tokens of every whole text, and whether it has more than ``limit`` tokens."""
    shared = shipped(docs.sparkSession, path)

    def counted(batches):
        counts = counter(shared.value)
        for batch in batches:
            n = [counts.count(text) for _, texts in text_runs(batch, "text") for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(byte_lengths(batch.column("text"))), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(counted, SCHEMA)
