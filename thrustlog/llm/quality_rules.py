"""Quality rules: a table of thresholds compiled into one projection (operator 8).

Words are the longest runs of characters other than space and the controls 9 to 13, over the whole
text. ``RULES`` compares ratios of the measures, all columns of one projection without a shuffle;
nothing but built-in functions runs. Null text is empty; an empty text fails the base rules; null ids, ties and
repeated rows are judged row by row; other columns pass through ``accepted`` unchanged.
"""

from pyspark.sql import functions as F

# Frequent words of four languages.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this an or at from "
    "der die und den von das mit ist im dem ein eine zu auf nicht sich auch des als sie "
    "le la de et les que en un une du pour qui dans est au sur par pas "
    "el y los se del las por con no su para es lo a"
).split()

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines"]

# rule: (measure, per what, least, most); None is no bound.
RULES = {
    "mean_word_length": ("word_chars", "n_words", 2.5, 12.0),
    "symbols_per_word": ("n_symbols", "n_words", None, 0.1),
    "stop_word_share": ("n_stop_words", "n_words", 0.06, None),
    "duplicate_line_share": ("n_dup_lines", "n_lines", None, 0.5),
    "words_per_line": ("n_words", "n_lines", 1.5, None),
    "bullet_line_share": ("n_bullet_lines", "n_lines", None, 0.9),
    "ellipsis_line_share": ("n_ellipsis_lines", "n_lines", None, 0.3),
}


def stop_forms(words=STOP_WORDS):
    """The words as they stand in running text: either case of the first letter, a mark behind or not."""
    return [form + mark for word in words for form in (word, word.capitalize()) for mark in ("", ".", ",", ";", ":")]


def _measured(docs, text):
    """``row`` and the counts: one projection, written in steps so that no step computes a value twice."""
    parts = docs.select(F.struct("*").alias("row"), text.alias("text")).select(
        "row",
        F.char_length("text").alias("n_chars"),
        F.split("text", r"[ \t-\r]").alias("parts"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t-\r]")).alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    words = parts.select(
        "row", "n_symbols", "lines",
        F.array_remove("parts", "").alias("words"),
        (F.col("n_chars") - F.size("parts") + 1).cast("bigint").alias("word_chars"),
    ).select(
        "row", "words", "word_chars", "n_symbols",
        F.size(F.filter("words", lambda w: w.isin(stop_forms()))).cast("bigint").alias("n_stop_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: line.rlike(r"^[ \t]*[-•*·]"))).cast("bigint").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda line: line.rlike(r"(\.\.\.|…)\s*$"))).cast("bigint").alias("n_ellipsis_lines"),
    )
    rest = ["row", *MEASURES]
    n = F.size("words")
    hashes = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    whole = F.slice(hashes, 1, F.greatest(n - 2, F.lit(0)))
    hashed = words.select("*", n.cast("bigint").alias("n_words"), whole.alias("hashes"))
    # a text whose windows all have different hashes repeats none; in the others equal hashes meet by
    # sorting, and neighbours of equal hash count if their words are equal too
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = hashed.select(*rest, "words", F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"))
    found, held = F.col("ordered"), F.col("words")

    def same(a, b):
        equal = a["h"] == b["h"]
        for step in range(3):
            equal &= F.get(held, a["i"] + step) == F.get(held, b["i"] + step)
        return F.coalesce(equal, F.lit(False))

    twice = F.filter(found, lambda x, i: same(x, F.get(found, i - 1)) | same(x, F.get(found, i + 1)))
    spots = ordered.select(*rest, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("spots"))
    steps = F.transform("spots", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("spots", i + 1) - at, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0), lambda total, x: total + x)
    return spots.select(*rest, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def verdict(found, rules=None):
    """Whether the base rules fail, and whether the row passes them and every rule."""
    base = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
    passed = ~base
    for measure, per, least, most in (RULES if rules is None else rules).values():
        if least is not None:
            passed &= found[measure] >= least * found[per]
        if most is not None:
            passed &= found[measure] <= most * found[per]
    return base, passed


def judged(docs, rules=None, text_column="text"):
    """The document in struct ``row``, beside it its counts, ``base_failed`` and ``kept``."""
    found = _measured(docs, F.coalesce(docs[text_column].cast("string"), F.lit("")))
    base, kept = verdict(found, rules)
    columns = [*(found[c] for c in found.columns if c != "row"), base.alias("base_failed"), kept.alias("kept")]
    # never false, but a filter on the result is not moved below the steps, where it would repeat all of them
    here = F.spark_partition_id() >= 0
    return found.select("row", F.when(here, F.struct(*columns)).alias("found")).select("row", "found.*")


def accepted(docs, rules=None, text_column="text"):
    """The documents that every rule accepts, with their own columns."""
    return judged(docs, rules, text_column).where("kept").select("row.*")
