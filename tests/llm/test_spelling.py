import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from thrustlog.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, letters=6, least=5, every=199):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            counts[word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= least}


def brute_near(words):
    """By trying every edit over the letters that occur."""
    letters = sorted({c for w in words for c in w})
    found = {}
    for w in words:
        tried = {w[:i] + w[i + 1 :] for i in range(len(w))}
        for i in range(len(w) + 1):
            tried |= {w[:i] + c + w[i:] for c in letters}
            tried |= {w[:i] + c + w[i + 1 :] for c in letters if i < len(w)}
        found[w] = sorted((tried & words.keys()) - {w})
    return found


def brute(words, times=5):
    near, form = brute_near(words), {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(map(str, rows))


def got(df):
    return sorted(str(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_against_trying_every_edit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    words = brute_counts([tuple(r) for r in docs])
    expected = brute(words)
    assert len(expected) > 5000 and sum("None" not in x for x in expected) > 50
    assert got(queries.op11_spelling(spark, "/root/testdata/sf0.01")) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_words_against_trying_every_edit(spark, seed):
    draw = random.Random(seed)
    words = {"".join(draw.choice("aabé") for _ in range(draw.randrange(1, 8))): draw.choice([5, 5, 30, 200, 5000]) for _ in range(500)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(table)) == brute(words)
    near = {r["word"]: r["near"] for r in spelling.neighbours(table).collect()}
    assert near == {w: x for w, x in brute_near(words).items() if x}


def test_a_chain_of_forms_leads_to_its_last(spark):
    words = {"a" * (6 + i): 5 ** (i + 1) for i in range(8)}
    rows = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r["root"] for r in rows} == {"a" * 13}


def test_nulls_case_long_texts_and_clashing_columns(spark):
    long = "Straße ×÷ naïvetés " * 70_000 + "x" * 1_500_000
    rows = [(1, "Letters LETTERS letters Étudiant étudiant", 1, "a"), (1, None, 2, "b"), (None, "letters letters" * 3, 3, None), (2, "", None, "d"), (7, long, 5, "e")]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, word string")
    expected = brute_counts([r[:2] for r in rows])
    found = spelling.word_counts(docs)
    assert {r["word"]: r["n"] for r in found.collect()} == expected and found.columns == ["word", "n"]
    assert got(spelling.variants(found)) == brute(expected)
    assert got(spelling.variants(spelling.word_counts(docs.limit(0)))) == []
    named = docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text")
    assert {r["word"]: r["n"] for r in spelling.word_counts(named).collect()} == brute_counts([(None if r[0] is None else f"d{r[0]}", r[1]) for r in rows])


def test_slices_cut_no_word():
    text = "ab cdeéf " * 50
    for size in (1, 2, 7, 30):
        parts = list(spelling.slices(text, size))
        assert "".join(parts) == text and [w for p in parts for w in RUN.findall(p)] == RUN.findall(text)
