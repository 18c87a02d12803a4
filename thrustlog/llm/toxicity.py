"""Toxicity by a linear-chain CRF over tokens (operator 1).

Training. Tokens are labelled from the documents' labels: words and word beginnings that many toxic
documents have and hardly a clean one are taken, the commonest first; tokens of toxic documents that match
are toxic, all others are not. The CRF learns weights of
word and word-beginning features of a token and its neighbours, and of the transitions. A logistic
curve over the forward-backward marginals (the largest, and the log of one plus their sum) turns them into a score.
It is fitted on at most ``TRAIN_ROWS`` distinct texts of each label, taken by hash, of at most ``TRAIN_BYTES`` bytes each;
the model is a few thousand weights whatever the corpus.

Scoring reads every whole text. Null and empty texts have no tokens and get the score of no evidence; null ids and
repeated rows are scored row by row. Without usable training rows every score is 0. A null label is not used.
"""

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from thrustlog.llm.batches import text_runs
from thrustlog.llm.byte_bpe import Remembered
from thrustlog.llm.crf import Chain, fit, minimized

TOKEN = re.compile(r"[^\W\d_]+")
TRAIN_ROWS = 1000
TRAIN_BYTES = 20_000
BEGINNINGS = (3, 4, 5, 6)
MARKS = 64  # at most so many words and beginnings label tokens
FEATURES = 4000
FOLDS, HELD_OUT = 5, 0


def tokens(text):
    return TOKEN.findall(text.lower())


def word_features(word):
    """The word itself, and its beginnings."""
    return [f"{word}$", *(word[:n] for n in BEGINNINGS if len(word) > n)]


def marks(toxic, clean, most=MARKS):
    """Words and beginnings that mark toxic documents; both arguments are lists of sets of words.

    The commonest comes first; the words that it matches then count for no other.
    """
    counted = {}
    for i, words in enumerate(toxic):
        for w in words:
            counted.setdefault(w, []).append(i)
    against = Counter(f for words in clean for f in {f for w in words for f in word_features(w)})
    allowed = 0.02 * max(1.0, len(clean) / max(1, len(toxic)))
    least = max(3, len(toxic) // 50)
    having = {}
    for w in counted:
        for f in word_features(w):
            having.setdefault(f, []).append(w)
    numbers = {f: len({i for w in words for i in counted[w]}) for f, words in having.items()}
    numbers = {f: n for f, n in numbers.items() if n >= least and against[f] <= allowed * n}
    chosen = []
    while numbers and len(chosen) < most:
        best = max(numbers, key=lambda f: (numbers[f], len(f), f))
        mark = max((f for f in numbers if f.startswith(best) and numbers[f] >= 0.9 * numbers[best]), key=lambda f: (len(f), f))
        chosen.append(mark)
        touched = set()
        for w in having[mark]:
            if counted.pop(w, None) is not None:
                touched.update(word_features(w))
        for f in touched & numbers.keys():
            numbers[f] = len({i for w in having[f] for i in counted.get(w, ())})
            if numbers[f] < least:
                del numbers[f]
    return chosen


class Emissions:
    """Emission scores of token sequences: a bias, and a weight per feature for a token, the one before and the one after."""

    def __init__(self, words, starts, names):
        self.n = len(names)
        place = {f: i for i, f in enumerate(names)}
        vocabulary = {}
        self.word = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64)
        pairs = [(i, place[f]) for w, i in vocabulary.items() for f in word_features(w) if f in place]
        self.of_word, self.feature = np.array(pairs, np.int64).reshape(-1, 2).T
        self.words, self.size = len(vocabulary), 3 * self.n + 1
        self.first = np.zeros(len(words), bool)
        self.first[starts] = True
        self.last = np.append(self.first[1:], True) if len(words) else self.first

    def emissions(self, weights):
        own, before, after = (
            np.bincount(self.of_word, weights[k * self.n + self.feature], self.words)[self.word] if len(self.word) else np.zeros(0) for k in range(3)
        )
        return weights[-1] + own + np.where(self.first, 0, np.roll(before, 1)) + np.where(self.last, 0, np.roll(after, -1))

    def gradient(self, residual):
        found = np.empty(self.size)
        shifted = (residual, np.roll(np.where(self.first, 0, residual), -1), np.roll(np.where(self.last, 0, residual), 1))
        for k, values in enumerate(shifted):
            by_word = np.bincount(self.word, values, self.words)
            found[k * self.n : (k + 1) * self.n] = np.bincount(self.feature, by_word[self.of_word], self.n)
        found[-1] = residual.sum()
        return found


def evidence(probability, lengths):
    """Per sequence: a constant, the largest marginal, and the log of one plus the sum of those above one half."""
    start = np.cumsum(lengths) - lengths
    some = lengths > 0
    largest, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    if some.any():
        largest[some] = np.maximum.reduceat(probability, start[some])
        total[some] = np.add.reduceat(np.where(probability > 0.5, probability, 0.0), start[some])
    return np.stack([np.ones(len(lengths)), largest, np.log1p(total)], axis=1)


def trained(texts, labels):
    """A model, as JSON, from texts and their labels; empty if a label has no text."""
    words = [tokens(x) for x in texts]
    labels = np.array(labels, np.int64)
    sets = [set(x) for x in words]
    toxic = [x for x, y in zip(sets, labels, strict=True) if y]
    clean = [x for x, y in zip(sets, labels, strict=True) if not y]
    chosen = marks(toxic, clean) if toxic and clean else []
    if not chosen:
        return json.dumps({})
    marked = set(chosen)
    lengths = np.array([len(x) for x in words], np.int64)
    flat = [w for x in words for w in x]
    hit = Remembered(lambda w: not marked.isdisjoint(word_features(w)))
    truth = np.fromiter(map(hit.__getitem__, flat), bool, len(flat)) & np.repeat(labels == 1, lengths)
    common = Counter(f for x in sets for f in {f for w in x for f in word_features(w)})
    names = chosen + [f for f, n in sorted(common.items(), key=lambda x: (-x[1], x[0])) if f not in marked and n > 1][: FEATURES - len(chosen)]
    chain = Chain(lengths)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    features = Emissions(flat, starts, names)
    weights, transitions = fit(chain, features, truth, rounds=30)
    probability = chain.marginals(features.emissions(weights), transitions)
    x = evidence(probability, lengths)
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)

    def loss(w):
        z = x @ w
        value = share @ (np.logaddexp(0, z) - labels * z) + 0.5 * (w @ w)
        return value, x.T @ (share * (1 / (1 + np.exp(-z)) - labels)) + w

    curve = minimized(loss, np.zeros(3), 100)
    kept = {f: [round(float(weights[k * features.n + i]), 6) for k in range(3)] for i, f in enumerate(names)}
    return json.dumps({"features": kept, "bias": float(weights[-1]), "transitions": transitions.tolist(), "curve": curve.tolist()})


class Tagger:
    """Marginals, scores and spans of whole texts by a trained model."""

    def __init__(self, model):
        self.model = json.loads(model)
        self.table = [(0.0, 0.0, 0.0)]  # emission parts by distinct word; place 0 is a word without features
        self.place = Remembered(self._word, limit=150_000)

    def _word(self, word):
        weights = [x for f in word_features(word) if (x := self.model["features"].get(f))]
        if not weights:
            return 0
        sums = tuple(map(sum, zip(*weights, strict=True)))
        if len(self.table) >= 150_000:  # the table empties with what remembers its places
            self.place.clear()
            del self.table[1:]
        self.table.append(sums)
        return len(self.table) - 1

    def scored(self, texts):
        """``(score, spans)`` per text; spans are character ranges of tokens whose marginal is one half or more."""
        if not self.model:
            return [(0.0, []) for _ in texts]
        words = [tokens(x) for x in texts]
        lengths = np.array([len(x) for x in words], np.int64)
        flat = [w for x in words for w in x]
        before = len(self.table)
        word = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        if len(self.table) < before:  # emptied in between: once more, from the beginning
            self.place.clear()
            del self.table[1:]
            word = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        table = np.array(self.table)
        first = np.zeros(len(flat), bool)
        start = np.cumsum(lengths) - lengths
        first[start[lengths > 0]] = True
        last = np.append(first[1:], True) if len(flat) else first
        emissions = self.model["bias"] + table[word, 0]
        emissions += np.where(first, 0, np.roll(table[word, 1], 1)) + np.where(last, 0, np.roll(table[word, 2], -1))
        probability = Chain(lengths).marginals(emissions, np.array(self.model["transitions"]))
        scores = 1 / (1 + np.exp(-(evidence(probability, lengths) @ np.array(self.model["curve"]))))
        high = np.flatnonzero(probability >= 0.5)
        found = [[] for _ in texts]
        owner = np.searchsorted(start + lengths, high, side="right")
        for i in np.unique(owner).tolist():
            spots = (high[owner == i] - start[i]).tolist()
            ranges = _ranges(texts[i], set(spots))
            found[i] = [(a, b, float(probability[start[i] + k])) for k, (a, b) in zip(spots, ranges, strict=True)]
        return list(zip(scores.tolist(), found, strict=True))


def _ranges(text, spots):
    """Character ranges of the tokens at the given places; offsets are those of the text itself."""
    lowered = text.lower()
    shift = None
    if len(lowered) != len(text):  # a few letters grow in lower case
        shift = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
    found = []
    for k, token in enumerate(TOKEN.finditer(lowered)):
        if k in spots:
            a, b = token.span()
            found.append((a, b) if shift is None or len(shift) < b else (int(shift[a]), int(shift[b - 1]) + 1))
    return found


def held_out(id_column):
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learned(docs, labels, label="toxic", id_column="doc_id", text_column="text", train_rows=TRAIN_ROWS, train_bytes=TRAIN_BYTES):
    """The model, trained in one task on a bounded sample of the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    named = labels.select(labels[id_column].cast("bigint").alias("doc_id"), labels[label].cast("int").alias("label"))
    usable = named.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    # twice the rows wanted: copies and long texts fall away
    share = F.when(F.col("label") == 1, 2.0 * train_rows / max(1, counts.get(1, 0))).otherwise(2.0 * train_rows / max(1, counts.get(0, 0)))
    drawn = usable.where(draw < share)
    texts = docs.select(docs[id_column].cast("bigint").alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    sample = texts.where(F.octet_length("text") <= train_bytes).join(F.broadcast(drawn), "doc_id")
    distinct = sample.groupBy("text").agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    bounded = distinct.withColumn("place", F.row_number().over(order)).where(F.col("place") <= train_rows).select("text", "label", "doc_id")

    def train(batches):
        rows = sorted((i, t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([trained([t for _, t, _ in rows], [y for _, _, y in rows])])], names=["model"])

    models = bounded.repartition(1).mapInArrow(train, "model string").collect()
    return spark.sparkContext.broadcast(models[0]["model"] if models else json.dumps({}))


def scored(docs, model, text_column="text"):
    """The document in struct ``row``, its score, verdict and toxic spans. ``model`` is what ``learned`` returns."""

    def tag(batches):
        tagger = Tagger(model.value)
        for batch in batches:
            for start, texts in text_runs(batch, "text", 1 << 20):
                found = tagger.scored(texts)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
                spans = [[{"start": a, "end": b, "probability": p} for a, b, p in x] for _, x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(start, len(texts)), pa.array([x for x, _ in found], pa.float64()), pa.array([int(x >= 0.5) for x, _ in found], pa.int32()), pa.array(spans, kind)],
                    names=["row", "score", "predicted", "spans"],
                )

    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    added = StructType.fromDDL("score double, predicted int, spans array<struct<start:int,end:int,probability:double>>")
    return rows.mapInArrow(tag, StructType([rows.schema["row"], *added.fields]))


def accepted(docs, model, text_column="text"):
    """The documents whose score is below one half, with their own columns.

    Only texts go to Python and only scores come back; the documents themselves stay in the JVM.
    """

    @F.arrow_udf(DoubleType())
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(model.value)
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            found = [x for _, texts in text_runs(batch, "text", 1 << 20) for x, _ in tagger.scored(texts)]
            yield pa.array(found, pa.float64())

    return docs.where(score(F.coalesce(docs[text_column].cast("string"), F.lit(""))) < 0.5)
