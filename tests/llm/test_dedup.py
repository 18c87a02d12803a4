import random
import re

import numpy as np
import xxhash

from thrustlog.llm import components, exact_dedup, simhash
from thrustlog.llm.keep import bit_map, flagged

ROWS = [
    (1, "a", "q", 1), (1, "a", "q", 1), (2, "a", "r", 1), (2, "a", "s", 2), (None, None, "t", 1), (None, "", "u", None), (3, "b", None, 1),
    (7, "a ", "x", 1), (9, "A", "x", 1), (10, "x" * 300_000, "l", 1), (11, "x" * 300_000, "l", 1), (12, "x" * 299_999 + "y", "l", 1),
]
SCHEMA = "doc_id long, text string, print string, kept int"


def groups(rows):
    found = {}
    for i, t, *_ in rows:
        found.setdefault(t or "", []).append(i)
    return found


def check_exact(rows, got):
    expected = groups(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r["text_sha256"], []).append(r)
    assert len(by_text) == len(expected)
    for ids in expected.values():
        last = max((i for i in ids if i is not None), default=None)
        match = [g for g in by_text.values() if sorted(map(str, (r["doc_id"] for r in g))) == sorted(map(str, ids)) and {r["keep_id"] for r in g} == {last}]
        assert match and {r["group_size"] for r in match[0]} == {len(ids)}
        assert [r["doc_id"] for r in match[0] if r["kept"]] == [last]


def test_polynomials_combine():
    p = exact_dedup.Polynomial()
    for n in (0, 1, 5, 1023, 1024, 1025, 5000):
        text = random.Random(n).randbytes(n)
        expected = [0, 0]
        for b in text:
            expected = [(h * base + b) % p.prime for h, base in zip(expected, p.bases, strict=True)]
        assert p.fingerprints([b"other", text, b""])[1] == expected[0] | expected[1] << 31
        whole = p.fingerprints([text + b"tail"])[0]
        tail = p.fingerprints([b"tail"])[0]
        joined = p.combine(expected, [tail & p.prime, tail >> 31], 4)
        assert whole == joined[0] | joined[1] << 31


def test_equal_texts(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    check_exact(ROWS, exact_dedup.decided(docs).collect())


def test_colliding_fingerprints_are_told_apart(spark):
    weak = exact_dedup.Polynomial(bases=(3, 5), prime=7)
    rows = [(i, f"{i % 120:04d}") for i in range(300)] + ROWS
    rows = [r[:2] for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_exact([(i, t) for i, t in rows], [r for r in exact_dedup.decided(docs, weak).collect()])


def test_one_row_of_each_text_stays(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r["text"] or "" for r in rows) == sorted(groups(ROWS))
    assert {r["doc_id"] for r in rows if r["text"] == "a"} == {2} and {r["doc_id"] for r in rows if r["text"] == "x" * 300_000} == {11}
    assert exact_dedup.deduplicated(docs.limit(0)).count() == 0 and exact_dedup.decided(docs.limit(0)).count() == 0


def test_bit_map_misses_no_key(spark):
    keys = spark.range(-500, 500, 7).selectExpr("xxhash64(id) AS k")
    rows = spark.range(-500, 500).selectExpr("xxhash64(id) AS k", "id")
    for words in (1, 64, 1 << 18):
        may = {r["id"] for r in flagged(rows, rows["k"], bit_map(keys, words), words).where("_may").collect()}
        assert set(range(-500, 500, 7)) <= may
    assert len(may) == len(range(-500, 500, 7))


def naive_print(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_groups(values, distance=4):
    values = np.array(values, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_fingerprints():
    draw = random.Random(4)
    texts = ["", "  ", "A b", "a b c d", "a b c d e É", " ".join(draw.choice(["x", "Y", "zz"]) for _ in range(900)), "x\x00y \u00a0z"]
    got = [int(x) % 2**64 for x in simhash.fingerprints([t.encode() for t in texts], 4)]
    assert got == list(map(naive_print, texts))


def test_index_against_all_pairs():
    draw = np.random.default_rng(1)
    assert not len(simhash.GrayIndex(np.zeros(0, np.uint64)).components(4))
    for n in (1, 2, 9, 70, 100, 1500):
        base = draw.integers(0, 2**63, max(1, n // 6), dtype=np.uint64)
        flips = [np.uint64(sum(1 << b for b in draw.choice(64, k, replace=False).tolist())) for k in range(7)]
        values = np.unique(np.concatenate([base ^ f for f in flips])[:n])
        index = simhash.GrayIndex(values)
        assert (index.components(4) == naive_groups(index.values)).all()


def test_blocks_leave_no_pair_out():
    draw = random.Random(3)
    for distinct in (10, 10**6, 10**12):
        masks = simhash.blocks(4, distinct)
        assert len(masks) == 5
        for _ in range(300):
            differ = sum(1 << b for b in draw.sample(range(64), 4))
            assert any(not m & differ for m in masks)


def test_components(spark):
    draw = random.Random(7)
    pairs = [(draw.randrange(-400, 400), draw.randrange(-400, 400)) for _ in range(350)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    least = {}

    def find(x):
        while least.get(x, x) != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {x for p in pairs for x in p}
    assert got == {x: find(x) for x in nodes if find(x) != x}


def test_groups_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    prints = [naive_print(t) for _, t in rows]
    label = naive_groups(prints)
    first = {}
    for (i, _), k in zip(rows, label.tolist(), strict=True):
        first[k] = min(i, first.get(k, i))
    expected = sorted((i, f"{p:016x}", first[k]) for (i, _), p, k in zip(rows, prints, label.tolist(), strict=True))
    assert sorted(tuple(r)[:3] for r in simhash.grouped(docs).collect()) == expected
    kept = simhash.deduplicated(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values()) and kept.columns == docs.columns


def test_null_ids_ties_and_empty_texts(spark):
    rows = [(1, "a b", 1), (1, "a b", 1), (2, "A B", 1), (None, "", 1), (None, None, 1), (5, "", 1), (7, None, 1), (8, "x y z", 1), (None, "only null", 1), (None, "other null here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int")
    got = sorted(str((r["doc_id"], r["component_id"])) for r in simhash.grouped(docs).collect())
    assert got == sorted(map(str, [(1, 1), (1, 1), (2, 1), (None, 5), (None, 5), (5, 5), (7, 5), (8, 8), (None, None), (None, None)]))
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["text"]) for r in kept.collect()) == sorted(["a b", "", "x y z", "only null", "other null here"])
    assert simhash.grouped(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0
