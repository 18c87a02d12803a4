"""Byte-level BPE vocabulary: merge ranks, pre-tokens, and cutting a text into units that repeat.

A unit is what stands between two single spaces. A pre-token starts at every space that follows a
character other than white space, so the tokens of a text are those of its units in turn, and the
tokens of a unit can be remembered.
"""

import json
import sys
import unicodedata
from functools import cached_property, lru_cache

import regex

PRETOKEN = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
AFTER_SPACE = regex.compile(r"\s ")
UNIT_END = regex.compile(r"(?<!\s) ")
SHIFT = 32
MARKS = frozenset(".,;:!?")


@lru_cache(1)
def unassigned():
    """Matches a code point without a category here; libraries of other Unicode versions may know it."""
    spans, start = [], None
    for cp in range(sys.maxunicode + 2):
        none = cp <= sys.maxunicode and unicodedata.category(chr(cp)) == "Cn"
        if none and start is None:
            start = cp
        elif not none and start is not None:
            spans.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return regex.compile(f"[{''.join(spans)}]")


def byte_symbols():
    """The printable character that stands for each byte in a vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks and token bytes of a tokenizer file of kind byte-level BPE, given as its JSON text."""

    def __init__(self, text):
        data = json.loads(text)
        model, self._text = data["model"], text
        symbols = byte_symbols()
        ids = model["vocab"]
        self.byte_ids = [ids[symbols[b]] for b in range(256)]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[left] << SHIFT | ids[right]] = rank
            self.merged.append(ids[left + right])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        back = {c: b for b, c in symbols.items()}
        self.token_bytes = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.token_bytes |= {i: content.encode() for content, i in self.special.items()}

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self._text).pre_tokenizer

    def pretokens(self, text):
        if text.isascii() or text.isprintable() or not unassigned().search(text):
            return PRETOKEN.findall(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def unit_pretokens(self, unit):
        """Pre-tokens of a space and ``unit``; most units are a word, or a word and a mark."""
        if unit.isalpha():
            return [" " + unit]
        if unit[-1:] in MARKS and unit[:-1].isalpha():
            return [" " + unit[:-1], unit[-1]]
        return self.pretokens(" " + unit)

    def plain_parts(self, text):
        """``(plain text, id of the special token after it or None)`` in turn."""
        start = 0
        if self._special is not None:
            for found in self._special.finditer(text):
                yield text[start : found.start()], self.special[found.group()]
                start = found.end()
        yield text[start:], None


def units(text):
    """The first unit, and the others without the space that each begins with."""
    if text.isascii() and not any(space + " " in text for space in " \n\t\r\v\f"):
        parts = text.split(" ")
    elif not AFTER_SPACE.search(text):
        parts = text.split(" ")
    else:
        parts = UNIT_END.split(text)
    return parts[0], parts[1:]


@lru_cache(4)
def vocabulary(text):
    return Vocabulary(text)


class Remembered(dict):
    """Values of keys by ``make``; emptied at ``limit`` entries, so its memory is bounded; long keys are not kept."""

    def __init__(self, make, limit=250_000, longest=64):
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def shipped(spark, path):
    """The vocabulary file's text as a broadcast: one file of a few megabytes, whatever the corpus holds."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())
