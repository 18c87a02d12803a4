"""Spelling variants by permuterm rotations (operator 11).

Words that differ by one inserted, deleted or replaced letter are near. Every word gets an end mark and is turned so
that each of its letters comes last once: letter c of ``a c b`` gives the rotation ``b $ a c``. Rotations that agree but
for the last letter have the letter replaced; a rotation that equals another one without its last letter is the
word with the letter taken out. So each rotation is entered under two prefixes, itself and itself without the edited
letter, the entries of a prefix come together sorted, and a scan of each gives every member its near words. A prefix
holds one whole rotation and one more for each letter of the alphabet at most, whatever the corpus holds. A letter taken out of
a stretch of equal ones counts once, at the first of them.

A scan returns counts and the best neighbour of each member, not pairs; ``neighbours`` lists the near words themselves.
Counts of words are summed in Python per task before the shuffle. Null text has no words; a null id counts as empty;
repeated rows count each time; words of equal frequency are told apart by code point order; other columns are not read; an
empty table gives no words.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from thrustlog.llm.batches import text_runs
from thrustlog.session import stored_table

WORD = re.compile("[A-Za-zÀ-ÿ]+")
END = "$"
SLICE = 1 << 20
TASK_WORDS = 200_000
DROP_EVERY = 199


def slices(text, size=SLICE):
    """The text in parts of about ``size`` characters that cut no word; a longer word stays whole."""
    start = 0
    while start < len(text):
        stop = start + size
        if stop < len(text) and (found := WORD.match(text, stop - 1)):
            stop = found.end()
        yield text[start:stop]
        start = stop


def lowered(text):
    """Only A to Z in lower case."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def misspelt(word, doc_id, every=DROP_EVERY):
    """The word without the letter that its hash names, where ``every`` divides the hash; else the word."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % every else word[: (at := h % len(word))] + word[at + 1 :]


def word_counts(docs, least_letters=6, least=5, every=DROP_EVERY, id_column="doc_id", text_column="text"):
    """Distinct words of at least ``least_letters`` letters and ``least`` occurrences, with their number ``n``."""

    def count(batches):
        counts = Counter()

        def rows():
            kept = {w: n for w, n in counts.items() if len(w) >= least_letters}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, texts in text_runs(batch, "text"):
                for i, text in enumerate(texts, start):
                    for part in slices(text):
                        for word, n in Counter(WORD.findall(lowered(part))).items():
                            counts[misspelt(word, ids[i] or "", every)] += n
                        if len(counts) >= TASK_WORDS:
                            yield rows()
        yield rows()

    rows = docs.select(docs[id_column].cast("string").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    counted = rows.mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rotations(words):
    """Each word's rotations under their prefixes: ``whole`` under itself, else under itself without its last letter."""
    letters = F.char_length("word")
    turned = words.select("word", "n", letters.alias("letters"), F.explode(F.sequence(F.lit(0), letters)).alias("at"))

    def part(start, length=None):
        return F.substring("word", start, F.col("letters") if length is None else length)

    behind, front = part(F.col("at") + 1), part(F.lit(1), F.col("at"))
    letter, before = part(F.col("at"), F.lit(1)), part(F.lit(1), F.col("at") - 1)
    whole = F.struct(F.concat(behind, F.lit(END), front).alias("prefix"), F.lit(True).alias("whole"), F.lit(True).alias("first"))
    # the letter before the turn comes last; it is the first of its stretch if another letter or none stands before it
    stretch = (F.col("at") == 1) | (part(F.col("at") - 1, F.lit(1)) != letter)
    edited = F.struct(F.concat(behind, F.lit(END), before).alias("prefix"), F.lit(False).alias("whole"), stretch.alias("first"))
    entries = F.when(F.col("at") == 0, F.array(whole)).otherwise(F.array(whole, edited))
    return turned.select("word", "n", F.explode(entries).alias("entry")).select("word", "n", "entry.*")


def _groups(words):
    """Per prefix with more than one entry: the whole rotation's word, if any, and the others, the most frequent first."""
    entry = F.struct((-F.col("n")).alias("rank"), "word", "first")
    grouped = rotations(words).groupBy("prefix").agg(
        F.max(F.when(F.col("whole"), entry)).alias("whole"),
        F.sort_array(F.collect_list(F.when(~F.col("whole"), entry))).alias("edited"),
    )
    return grouped.where(F.size("edited") + F.col("whole").isNotNull().cast("int") > 1)


def _best(a, b):
    return F.when(b.isNull() | (a < b), a).otherwise(b)


def scanned(words):
    """Per prefix and member: how many near words the member has there, and the best of them by number, then by order."""
    groups = _groups(words)
    size, edited, whole = F.size("edited"), F.col("edited"), F.col("whole")
    # of several first letters only those that are the first of their stretch link to the whole rotation
    linked = F.filter(edited, lambda x: x["first"])
    of_whole = F.array(F.struct(whole["word"].alias("word"), F.size(linked).cast("bigint").alias("near"), F.get(linked, F.lit(0)).alias("best")))

    def member(x, i):
        other = F.when(i == 0, F.get(edited, F.lit(1))).otherwise(F.get(edited, F.lit(0)))
        shorter = F.when(x["first"], whole)
        near = (size - 1 + shorter.isNotNull().cast("int")).cast("bigint")
        best = F.when(other.isNull(), shorter).otherwise(_best(other, shorter))
        return F.struct(x["word"].alias("word"), near.alias("near"), best.alias("best"))

    members = F.concat(F.transform(edited, member), F.when(whole.isNotNull(), of_whole).otherwise(F.array().cast("array<struct<word:string,near:bigint,best:struct<rank:bigint,word:string,first:boolean>>>")))
    return groups.select(F.explode(members).alias("m")).select("m.word", "m.near", F.struct("m.best.rank", "m.best.word").alias("best")).where("near > 0")


def neighbours(words):
    """``word`` and the array of its near words; words without any are left out."""
    edited, whole = F.col("edited"), F.col("whole")

    def member(x):
        others = F.transform(F.filter(edited, lambda y: y["word"] != x["word"]), lambda y: y["word"])
        shorter = F.when(x["first"] & whole.isNotNull(), F.array(whole["word"])).otherwise(F.array().cast("array<string>"))
        return F.struct(x["word"].alias("word"), F.concat(others, shorter).alias("near"))

    longer = F.transform(F.filter(edited, lambda y: y["first"]), lambda y: y["word"])
    of_whole = F.when(whole.isNotNull(), F.array(F.struct(whole["word"].alias("word"), longer.alias("near")))).otherwise(F.array().cast("array<struct<word:string,near:array<string>>>"))
    found = _groups(words).select(F.explode(F.concat(F.transform(edited, member), of_whole)).alias("m")).select("m.*")
    return found.where(F.size("near") > 0).groupBy("word").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))


def roots(forms):
    """``forms`` (word, form) and the last form that following them reaches; each pass doubles the steps taken."""
    now = forms.select("word", "form", F.col("form").alias("root"))
    while True:
        now = stored_table(now, "spelling-roots")
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        went = now.join(ahead, "root", "left")
        if went.where("further IS NOT NULL").isEmpty():
            return now
        now = went.select("word", "form", F.coalesce("further", "root").alias("root"))


def variants(words, times=5):
    """Per word: its ``form``, the near word of largest number if that is at least ``times`` its own; the ``root`` that
    forms lead to; its number, how many near words it has, and the form's number. ``words`` has ``word`` and ``n``."""
    words = stored_table(words.select("word", "n"), "spelling-words")
    near = scanned(words).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    most = -F.col("best.rank")
    usual = most >= times * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("best.word")).alias("form"), F.when(usual, most).alias("form_n"),
    )
    judged = stored_table(judged, "spelling-forms")
    found = roots(judged.where("form IS NOT NULL").select("word", "form")).select("word", "root")
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
