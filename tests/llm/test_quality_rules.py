import re
from collections import Counter

from thrustlog.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = " ".join(f"the w{i} of" for i in range(30)) + "."


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    forms = set(rules.stop_forms())
    found = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_stop_words": sum(w in forms for w in words),
        "n_bullet_lines": sum(bool(re.match(r"[ \t]*[-•*·]", x)) for x in lines),
        "n_ellipsis_lines": sum(bool(re.search(r"(\.\.\.|…)\s*$", x)) for x in lines),
    }
    base = found["n_words"] < 50 or 100 * found["n_repeat_words"] > 50 * found["n_words"]
    kept = not base
    for measure, per, least, most in rules.RULES.values():
        kept &= (least is None or found[measure] >= least * found[per]) and (most is None or found[measure] <= most * found[per])
    return found | {"base_failed": base, "kept": kept}


TEXTS = [
    None, "", " \t\n", "one", "a b", "a b c", "a b c a b c", "a a a a a", PROSE, PROSE + "\n" + PROSE, "#$%&|<>*" * 40,
    "\n".join(["- the item of it"] * 60), "word... \n" * 60, "the\x0bof\x0cand\rto\x00in is　it " * 20, "Ünïcode wörds " * 40,
    " ".join(f"der w{i} die" for i in range(4000)),
]


def test_measures_and_verdicts(spark):
    rows = [(i, t, None if i % 2 else "x", "n") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, rows[8], (None, PROSE, "x", "n")], "doc_id long, text string, words string, n_words string")
    got = rules.judged(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        expected = brute(r["row"]["text"])
        assert {k: r[k] for k in expected} == expected, r["row"]["text"]
    kept = rules.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.toPandas()["doc_id"].fillna(-1)) == sorted(-1 if r["row"]["doc_id"] is None else r["row"]["doc_id"] for r in got if r["kept"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rules.judged(docs).count() == 0


def test_no_python_and_no_shuffle_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_good_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = rules.judged(docs).selectExpr("row.doc_id", "base_failed", "kept").join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in rows)
