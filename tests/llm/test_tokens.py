import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from thrustlog.llm import bpe_codec, packing, token_counts
from thrustlog.llm.byte_bpe import Remembered, Vocabulary, units

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "b", "the", " ", "  ", "\n", " \n", "\t", "é", "ß", "1", "23", "!", "..", "'s", "'ll", "'", " ", "　", "中", "文字", "🙂",
    "́", "<|endoftext|>", "\x1c", "\x85", "ᲊ", "\U000323b0", "﻿", "_", " x", "İ", "٣", "²", "\r\n", " ", "\x00", "word", ",",
]
ROWS = [(1, "Hello world, it's"), (2, ""), (3, None), (None, "a  b\n c"), (1, "Hello world, it's"), (4, "x" * 5000), (5, "<|endoftext|> a<|endoftext|>"), (6, "né " * 3000)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, encoding="utf-8") as file:
        return Vocabulary(file.read())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "n", 7) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string, start int")


def texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randrange(12))) for _ in range(n)]


def test_counts_ids_and_decoded_texts_are_the_librarys(library, vocab):
    counts, codec, packer = token_counts.Counter(vocab), bpe_codec.Codec(vocab), packing.LibraryCodec(vocab)
    for text in [*texts(4000, 5), *(t or "" for _, t in ROWS)]:
        ids = library.encode(text, add_special_tokens=False).ids
        coded = codec.encode(text)
        assert np.frombuffer(coded, "<u4").tolist() == ids
        assert packer.encode(text) == coded
        assert counts.count(text) == len(ids)
        assert codec.decode(coded).decode() == library.decode(ids, skip_special_tokens=False)


def test_units_join_to_the_text():
    for text in texts(2000, 6):
        first, rest = units(text)
        assert " ".join([first, *rest]) == text


def test_remembered_values_are_bounded():
    made = Remembered(str.upper, limit=3, longest=4)
    assert [made[x] for x in ("a", "b", "c", "d", "too long", "a")] == ["A", "B", "C", "D", "TOO LONG", "A"]
    assert len(made) <= 3 and "too long" not in made


def test_count_rows(docs, library):
    got = sorted(map(str, (tuple(r) for r in token_counts.token_counts(docs, PATH, limit=20).collect())))
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS]
    assert got == sorted(str((i, len((t or "").encode()), k, k > 20)) for (i, t), k in zip(ROWS, n, strict=True))


def test_codec_rows(docs, library):
    got = sorted(map(str, (tuple(r) for r in bpe_codec.code_digests(docs, PATH).collect())))
    expected = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append(str((i, len(ids), sha, hashlib.sha256((t or "").encode()).hexdigest())))
    assert got == sorted(expected)
    for row in bpe_codec.encoded(docs, PATH).collect():
        assert library.decode(row["ids"], skip_special_tokens=False) == row["decoded"]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert token_counts.token_counts(none, PATH).count() == 0
    assert bpe_codec.code_digests(none, PATH).count() == 0
    assert packing.packed(none, PATH).count() == 0


def test_best_fit_takes_the_tightest_window():
    draw = random.Random(2)
    for size in (1, 2, 7, 64, 100):
        sizes = sorted((draw.randint(1, size) for _ in range(300)), reverse=True)
        got, n = packing.best_fit(sizes, size)
        rooms = []
        for need, (window, offset) in zip(sizes, got, strict=True):
            fits = [r for r in rooms if r >= need]
            if fits:
                assert size - offset == min(fits)
                assert rooms[window] == min(fits)
            else:
                assert (window, offset) == (len(rooms), 0)
                rooms.append(size)
            rooms[window] -= need
        assert n == len(rooms)


def check_pieces(rows, ids_of, size):
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= size for n in used.values())
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, pieces in by_doc.items():
        copies, ids = ids_of[doc]
        assert sorted((r["start"], r["length"]) for r in pieces) == sorted(
            (k, min(size, len(ids) - k)) for k in range(0, len(ids), size) for _ in range(copies)
        )
        for r in pieces:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    return used


def test_packed_pieces_cover_every_id_once(docs, library):
    ids_of = {}
    for i, t in ROWS:
        n = ids_of.get(i, (0,))[0]
        ids_of[i] = (n + 1, [*library.encode(t or "", add_special_tokens=False).ids, 0])
    for groups in (2, 50_000):
        rows = packing.packed(docs, PATH, size=64, rows_per_group=groups).collect()
        assert {r["doc_id"] for r in rows} == set(ids_of)
        check_pieces(rows, ids_of, 64)


def test_sequences_hold_the_ids(docs, library):
    pieces = packing.packed(docs, PATH, size=64, with_ids=True)
    rows = packing.sequences(pieces, size=64, pad_id=-1).collect()
    assert all(len(r["input_ids"]) == 64 and r["input_ids"][r["used"] :] == [-1] * (64 - r["used"]) for r in rows)
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert sum(r["used"] for r in rows) == total


def test_padding_is_small(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.packed(docs, PATH).collect()
    ids_of = {r["doc_id"]: (1, [*library.encode(r["text"], add_special_tokens=False).ids, 0]) for r in docs.collect()}
    used = check_pieces(rows, ids_of, 1024)
    assert sum(1024 - n for n in used.values()) < 0.005 * sum(used.values())
