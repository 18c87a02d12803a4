import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_tokens import PARTS

from thrustlog.llm import rank_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = rank_bpe.read_ranks(PATH)
ROWS = [
    (1, "Hello world, it's", "a", 1), (2, "", "b", 2), (3, None, None, None), (None, "a  b\n c", "c", 3), (1, "Hello world, it's", "a", 1),
    (4, "x" * 5000 + "aab" * 3000, "d", 4), (5, "<|endoftext|> a<|endoftext|>", "e", 5), (6, "né wörd " * 60_000, "f", 6), (7, " " * 70_000 + "\n" * 500, "g", 7),
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def own(spark):
    return rank_bpe.RankCodec(rank_bpe.shipped(spark, PATH, PATTERN).value)


def ids(own, texts):
    found, decoded = [b""] * len(texts), [b""] * len(texts)
    for i, coded, text in own.coded(texts):
        found[i] += coded
        decoded[i] += text
    return [np.frombuffer(x, "<u4").tolist() for x in found], decoded


def test_ids_are_the_librarys(own, library):
    draw = random.Random(9)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(14))) for _ in range(4000)]
    texts += ["".join(draw.choice("etaoinsh") for _ in range(3000)), "՘a՘ 1\U00011de0", "Ᲊᲊ"]
    found, decoded = ids(own, texts)
    assert found == library.encode_ordinary_batch(texts)
    assert decoded == [t.encode() for t in texts]


def test_one_contraction_a_step_gives_the_same(own, library):
    texts = ["mississippi aaaaaaaaaaa bananabanana " * 3, "ababababab" * 20]
    assert own.together
    own.together = False
    own.known.clear()
    try:
        assert ids(own, texts)[0] == library.encode_ordinary_batch(texts)
    finally:
        own.together = True
        own.known.clear()


def test_a_file_whose_merges_fall_contracts_one_pair_a_step(spark, tmp_path):
    """Here ``xab`` outranks ``ab``: after the first ``ab`` the pair x, ab comes before the second ``ab``."""
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"abx": 256, b"ab": 257, b"xab": 258}
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    own = rank_bpe.RankCodec(rank_bpe.shipped(spark, str(path), r"\w+|\W+").value)
    assert not own.together
    library = tiktoken.Encoding("small", pat_str=r"\w+|\W+", mergeable_ranks=ranks, special_tokens={})
    texts = ["abxab", "xabxabx", "abababxabxab xxab"]
    assert ids(own, texts)[0] == library.encode_ordinary_batch(texts)


def test_work_follows_the_neighbours_that_change(own, library, monkeypatch):
    """Words that cannot merge any more leave, and only new neighbours are looked up again."""
    draw, rows = random.Random(3), []
    words = ["".join(draw.choice("etaoinsh") for _ in range(draw.randrange(5, 12))) for _ in range(5000)] + ["x" * 3000]
    look = own._pair_ranks
    monkeypatch.setattr(own, "_pair_ranks", lambda word, ids, at: rows.append(len(at)) or look(word, ids, at))
    own.known.clear()
    assert ids(own, words)[0] == library.encode_ordinary_batch(words)
    assert sum(rows) < 3 * sum(map(len, words))


def test_portions_and_memory_are_bounded(own, monkeypatch):
    monkeypatch.setattr(rank_bpe, "PORTION", 7)
    monkeypatch.setattr(rank_bpe, "KEPT_WORDS", 20)
    texts = ["one two three four five six seven eight nine ten " * 3, "", "eleven", "a" * 50]
    assert all(sum(len(w) for _, w in p) <= 14 for p in own.portions(texts))
    assert ids(own, texts)[1] == [t.encode() for t in texts]
    assert len(own.known) <= 27


def test_rows(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string, n_tokens int")
    expected = []
    for i, t, *_ in ROWS:
        coded = np.array(library.encode_ordinary(t or ""), "<u4")
        expected.append(str((i, len(coded), hashlib.sha256(coded.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    got = rank_bpe.code_digests(docs, PATH, PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(expected)
    for row in rank_bpe.encoded(docs, PATH, PATTERN).collect():
        text = next(t or "" for i, t, *_ in ROWS if i == row["doc_id"])
        assert row["ids"] == library.encode_ordinary(text) and bytes(row["decoded"]).decode() == text
    assert rank_bpe.code_digests(docs.limit(0), PATH, PATTERN).count() == 0


def test_whole_table_against_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = rank_bpe.code_digests(docs, PATH, PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        coded = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert r["n_tokens"] == len(coded) // 4 and r["ids_sha256"] == hashlib.sha256(coded).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
