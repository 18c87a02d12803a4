"""Byte-level BPE by rounds of contractions over columns of word and id in each partition (operator 12).

The vocabulary is a rank file: token bytes and rank, which is the id. Every match of the pattern is a word.
The words of a run of texts that are not remembered become rows (word, id) in order of position, one per byte. Every
round looks new neighbours up in the merge table and contracts each word's leftmost pair of least rank; a word without
a pair that can merge leaves. Decoding joins ids to token bytes and aggregates them in order of position.

Where the ranks of a token's own merges never fall, a contraction makes no pair of lesser rank, so further pairs of
the same rank in the word are contracted in the same round, from left to right and without overlap. The file is
checked for that; with another file each round contracts the leftmost pair only.

Texts are read in portions of at most ``PORTION`` words, so neither ids nor rows of a long text are held at once.
A single word needs about 100 bytes of memory for each of its bytes. Null and empty texts have no tokens; null ids and
repeated rows are coded row by row; extra columns are not read; an empty table gives no rows.
"""

import base64
import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
import tiktoken

from thrustlog.llm.batches import RUN_BYTES, text_runs

DIGEST_SCHEMA = "doc_id {id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
CODE_SCHEMA = "doc_id {id}, ids array<int>, decoded binary"
PORTION = 400_000
CHUNK_BYTES = 1 << 17
KEPT_BYTES = 8 << 20
KEPT_WORDS = 500_000
MEMORY_MB = 256
NO_PAIR = np.iinfo(np.int32).max

# one thread aggregates the ordered rows; token bytes are held as the characters of the same numbers
DECODE = """
SELECT part, string_agg(text, '') AS text
FROM (SELECT part, text FROM coded JOIN tokens USING (id) ORDER BY pos) GROUP BY part
"""


def read_ranks(path):
    """Token bytes and rank of a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def own_merges(token, ranks):
    """The ranks of the contractions that the bytes of ``token`` go through, in turn."""
    parts, found = [token[i : i + 1] for i in range(len(token))], []
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1))
        if rank == len(ranks):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        found.append(rank)
    return found


def shipped(spark, path, pattern):
    """The vocabulary as a broadcast: one file of about a megabyte, whatever the corpus holds."""
    ranks = read_ranks(path)
    together = all(found == sorted(found) for found in (own_merges(token, ranks) for token in ranks))
    named = [(token.hex(), rank) for token, rank in ranks.items()]
    return spark.sparkContext.broadcast(json.dumps({"pattern": pattern, "together": together, "ranks": named}))


def unassigned(text):
    """Code points of the text without a category here; libraries of other Unicode versions may know them."""
    if text.isascii() or "".join(text.split()).isprintable():
        return set()
    return {c for c in set(text) if unicodedata.category(c) == "Cn"}


@lru_cache(4096)
def stand_in(pattern, char):
    """A letter, number or mark of the class that the library gives a code point this Python does not know."""
    ranks = {bytes([b]): b for b in range(256)} | {("a" + char).encode(): 256, ("1" + char).encode(): 257}
    library = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return next((c for c in "a1" if len(library.encode_ordinary(c + char)) == 1), "!")


class RankCodec:
    """Encodes and decodes texts; remembers words up to a bounded number and size."""

    def __init__(self, model):
        model = json.loads(model)
        self.text_pattern, self.together = model["pattern"], model["together"]
        self.pattern = regex.compile(self.text_pattern)
        ranks = {bytes.fromhex(token): rank for token, rank in model["ranks"]}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks = ranks
        self.known, self.size = {}, 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        self._store("tokens", {"id": pa.array(ranks.values(), pa.int32()), "text": pa.array([x.decode("latin-1") for x in ranks])})
        splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(splits, np.int64).reshape(-1, 3).T
        self.base = max(ranks.values()) + 1
        order = np.argsort(left * self.base + right)
        # a last row that no pair has, so that every search ends at a row
        self.pairs = np.append((left * self.base + right)[order], self.base**2)
        self.merged = np.append(merged[order], NO_PAIR).astype(np.int32)

    def _store(self, name, columns):
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def words(self, text):
        """Matches of the pattern, in turn."""
        rare = unassigned(text)
        if not rare:
            return (m.group() for m in self.pattern.finditer(text)) if len(text) > PORTION else self.pattern.findall(text)
        plain = text.translate({ord(c): stand_in(self.text_pattern, c) for c in rare})
        return (text[m.start() : m.end()] for m in self.pattern.finditer(plain))

    def portions(self, texts):
        """Lists of ``(number of the text, words)``, each list of about ``PORTION`` words at most."""
        found, n = [], 0
        for i, text in enumerate(texts):
            words = iter(self.words(text))
            while part := list(islice(words, PORTION)):
                found.append((i, part))
                n += len(part)
                if n >= PORTION:
                    yield found
                    found, n = [], 0
        if found:
            yield found

    def learn(self, words):
        """Remember the ids of all the words; others are forgotten where they get too many."""
        new = [w for w in words if w not in self.known]
        self.size += sum(map(len, new))
        if len(self.known) + len(new) > KEPT_WORDS or self.size > KEPT_BYTES:
            self.known.clear()
            new, self.size = list(words), sum(map(len, words))
        chunk, n = [], 0
        for word in new:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:  # a token as it stands
                self.known[word] = rank.to_bytes(4, "little")
                continue
            chunk.append((word, raw))
            n += len(raw)
            if n >= CHUNK_BYTES:
                self._merge(chunk, n)
                chunk, n = [], 0
        self._merge(chunk, n)

    def _pair_ranks(self, word, ids, at):
        """Rank of each pair that starts at a row of ``at``; no pair goes beyond its word."""
        at = at[at < len(ids) - 1]
        pairs = ids[at].astype(np.int64) * self.base + ids[at + 1]
        place = np.searchsorted(self.pairs, pairs)
        known = (self.pairs[place] == pairs) & (word[at] == word[at + 1])
        return at, np.where(known, self.merged[place], NO_PAIR)

    def _taken(self, word, rank, least):
        """Rows whose pair is contracted in this round: the leftmost of least rank of a word, or all without overlap."""
        hits = np.flatnonzero(rank == least)
        if not self.together:
            return hits[np.diff(word[hits], prepend=-1) != 0]
        place = np.arange(len(hits))
        first = np.maximum.accumulate(np.where(np.diff(hits, prepend=-2) != 1, place, 0))
        return hits[(place - first) % 2 == 0]

    def _contracted(self, word, ids):
        """Word and id of every token, a word's in turn, from the words' bytes; ``word`` never falls."""
        rank, done = np.full(len(ids), NO_PAIR, np.int32), []
        at, found = self._pair_ranks(word, ids, np.arange(len(ids)))
        rank[at] = found
        while len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(ids)))
            live = least != NO_PAIR
            if not live.all():
                done.append((word[~live], ids[~live]))
                word, ids, rank, least = word[live], ids[live], rank[live], least[live]
            taken = self._taken(word, rank, least)
            ids[taken] = rank[taken]
            kept = np.ones(len(ids), bool)
            kept[taken + 1] = False
            word, ids, rank = word[kept], ids[kept], rank[kept]
            taken -= np.arange(len(taken))
            for at in (taken, taken[taken > 0] - 1):  # new neighbours to the right and to the left
                rank[at] = NO_PAIR
                at, found = self._pair_ranks(word, ids, at)
                rank[at] = found
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return word[order], ids[order]

    def _merge(self, chunk, n):
        if not chunk:
            return
        word = np.repeat(np.arange(len(chunk), dtype=np.int32), [len(raw) for _, raw in chunk])
        word, ids = self._contracted(word, self.byte_ids[np.frombuffer(b"".join(raw for _, raw in chunk), np.uint8)])
        coded, counts = ids.astype("<u4").tobytes(), np.bincount(word, minlength=len(chunk))
        ends = (4 * np.cumsum(counts)).tolist()
        for (text, _), a, b in zip(chunk, [0, *ends], ends, strict=False):
            self.known[text] = coded[a:b]

    def decode(self, coded):
        """The bytes of each list of ids; ids are little-endian unsigned 32-bit integers."""
        counts = [len(x) // 4 for x in coded]
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
        part = np.repeat(np.arange(len(coded), dtype=np.int32), counts)
        self.db.register("coded", pa.table({"part": part, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
        found = [b""] * len(coded)
        for part, text in self.db.execute(DECODE).fetchall():
            found[part] = text.encode("latin-1")
        self.db.unregister("coded")
        return found

    def coded(self, texts):
        """``(number of the text, ids, bytes decoded from them)`` of every portion, in turn."""
        for portion in self.portions(texts):
            self.learn(set(chain.from_iterable(words for _, words in portion)))
            ids = [b"".join(map(self.known.__getitem__, words)) for _, words in portion]
            yield from zip((i for i, _ in portion), ids, self.decode(ids), strict=True)


@lru_cache(1)
def codec(model):
    return RankCodec(model)


def _mapped(docs, path, pattern, id_column, text_column, schema, columns):
    shared = shipped(docs.sparkSession, path, pattern)

    def mapped(batches):
        own = codec(shared.value)
        for batch in batches:
            for start, texts in text_runs(batch, "text", RUN_BYTES):
                ids = batch.column("doc_id")[start : start + len(texts)]
                yield pa.RecordBatch.from_arrays([ids, *columns[1](own, texts)], names=["doc_id", *columns[0]])

    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(mapped, schema.format(id=rows.schema["doc_id"].dataType.simpleString()))


def code_digests(docs, path, pattern, id_column="doc_id", text_column="text"):
    """Number and SHA-256 of every text's ids, and SHA-256 of the bytes decoded from them."""

    def columns(own, texts):
        counts = [0] * len(texts)
        ids, decoded = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for i, found, text in own.coded(texts):
            counts[i] += len(found) // 4
            ids[i].update(found)
            decoded[i].update(text)
        return [pa.array(counts, pa.int64()), pa.array([x.hexdigest() for x in ids]), pa.array([x.hexdigest() for x in decoded])]

    return _mapped(docs, path, pattern, id_column, text_column, DIGEST_SCHEMA, (["n_tokens", "ids_sha256", "decoded_sha256"], columns))


def encoded(docs, path, pattern, id_column="doc_id", text_column="text"):
    """The ids of every text as an array, and the bytes decoded from them."""

    def columns(own, texts):
        ids, decoded = [[] for _ in texts], [[] for _ in texts]
        for i, found, text in own.coded(texts):
            ids[i].append(found)
            decoded[i].append(text)
        ids = [b"".join(x) for x in ids]
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array([b"".join(x) for x in decoded], pa.binary())]

    return _mapped(docs, path, pattern, id_column, text_column, CODE_SCHEMA, (["ids", "decoded"], columns))
