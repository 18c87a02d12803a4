import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from thrustlog.llm import fill_middle

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    parts = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(parts) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(parts[:low]), "".join(parts[low:high]), "".join(parts[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(parts), "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(parts), form, len(prefix), len(middle), output


@pytest.mark.parametrize("alphabet", ["ab ", "é a\U0001f600", "aaaaaaaaaab.", ".\n", "a", "ÿZz[@`{ "])
def test_every_boundary(alphabet):
    draw = random.Random(alphabet)
    for n in (0, 1, 2, 9, 60, 65_535, 65_536, 65_537, 140_000):
        text = "".join(draw.choice(alphabet) for _ in range(n))
        ends = [0]
        for token in TOKEN.findall(text):
            ends.append(ends[-1] + len(token))
        found = fill_middle.BoundarySet(text)
        assert len(found) == len(ends) - 1
        places = range(len(ends)) if n < 100 else [0, len(ends) - 1, *draw.sample(range(len(ends)), min(len(ends), 150))]
        assert all(found.end(k) == ends[k] for k in places)


def test_each_kind_of_container():
    mixed = "a. " * 30_000
    kinds = {text[:3]: {type(c).__name__ for c in fill_middle.BoundarySet(text).containers} for text in (mixed, "." * 70_000, "abc" * 30_000, "word " * 500)}
    assert kinds == {"a. ": {"RunContainer"}, "...": {"RunContainer"}, "abc": {"ArrayContainer"}, "wor": {"ArrayContainer"}}
    draw = random.Random(4)
    text = "".join(draw.choice("ab.") for _ in range(66_000))
    assert type(fill_middle.BoundarySet(text).containers[0]).__name__ == "BitmapContainer"


def test_rows_and_exact_return(spark):
    rows = [
        (1, "Hello world, it's", 1, "x"), (2, "", 2, None), (3, None, 3, "y"), (None, "a <b> c", 4, "z"), (1, "Hello world, it's", 1, "x"), (4, "has <P> a mark", 5, "x"),
        (5, "é\U0001f600 a\nb\r\n" * 40_000, 6, "x"), (6, "ends in <S", 7, "x"), (7, "<M", None, "x"), (8, "P>x<", 8, "x"),
    ]
    rows += [(i, f"Number {i}: <{'S>' * (i % 3)} <{'' if i % 2 else 'P'} text of {i * i} words", 0, "w") for i in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    found = fill_middle.transformed(docs)
    assert found.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    expected = sorted(str((i, t, *brute(i, t))) for i, t, *_ in rows)
    assert sorted(str(tuple(r)) for r in found.collect()) == expected
    back = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert back.where("back <> coalesce(text, '')").count() == 0
    digests = fill_middle.digests(docs)
    sums = sorted(str((i, *brute(i, t)[:4], hashlib.sha256(brute(i, t)[4].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())) for i, t, *_ in rows)
    assert sorted(str(tuple(r)) for r in digests.collect()) == sums
    assert fill_middle.transformed(docs.limit(0)).count() == 0
