"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to lower-case words; a suffix automaton over word numbers holds every
word sequence of every item. Training words stream through it; the automaton's state and
the length of the longest match ending at each word tell which item windows end there. A
window is `window` consecutive words of an item, or all words of a shorter item. Matches of
a window's length or more are spans; a document whose spans cover `percent` of its words is
contaminated.

The items are dealt into blocks of about `block_words` words by a hash of the item, one
automaton each, so that what is broadcast at a time is bounded whatever the benchmark's
size; documents stream through the blocks one after the other.

Defined cases: null or empty text has no words and is never contaminated; items without
words or without an id match nothing; rows that repeat an item id count as one item.
Repeated documents come back as often as they came in; an empty benchmark leaves all
documents clean. Other columns are kept where the function says so.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.common import masked, unmasked, written

WINDOW = 13
PERCENT = 5
BLOCK_WORDS = 150_000
#: bytes that are no part of a word become blanks, A-Z become a-z
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before lower-casing


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of many word sequences, with the items behind its windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends = []
        for name, words in items:
            path, last = [], 0
            for w in words:
                last = self._extend(last, self.number.setdefault(w, len(self.number)))
                path.append(last)
            ends.append((name, len(words), path))
        self.items: dict[int, set[str]] = {}
        self.shorts: dict[int, list[tuple[int, str]]] = {}
        seen: list[int] = [-1] * len(self.link)
        for k, (name, size, path) in enumerate(ends):
            if 0 < size < window:
                state = path[-1]
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                self.shorts.setdefault(state, []).append((size, name))
            for state in path if size >= window else ():
                while state > 0 and seen[state] != k and self.length[state] >= window:
                    seen[state] = k
                    if self.length[self.link[state]] < window:
                        self.items.setdefault(state, set()).add(name)
                    state = self.link[state]
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.window_state = [0] * len(self.link)
        self.short_state = [0] * len(self.link)
        for state in order:
            up = self.link[state]
            fits = self.length[up] < window <= self.length[state]
            self.window_state[state] = state if fits else self.window_state[up]
            self.short_state[state] = state if state in self.shorts else self.short_state[up]
        sizes = [size for _, size, _ in ends if size]
        self.least = min([window, *sizes]) if sizes else 0

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, w, known)
        state = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return state

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[twin] = self.link[q]
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Disjoint sorted spans [first, end) covered by item windows, and the items that own them."""
        spans: list[list[int]] = []
        names: set[str] = set()
        states: set[int] = set()
        if not self.least:
            return spans, names
        following, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        state = size = 0
        for i, w in enumerate(map(self.number.get, words)):
            if w is None:
                state = size = 0
                continue
            to = following[state].get(w)
            if to is None:
                state = link[state]
                while state >= 0 and w not in following[state]:
                    state = link[state]
                if state < 0:
                    state = size = 0
                    continue
                size = length[state] + 1
                state = following[state][w]
            else:
                state = to
                size += 1
            if size < least:
                continue
            covered = 0
            if size >= window:
                covered = size
                states.add(self.window_state[state])
            short = self.short_state[state]
            while short > 0:
                for whole, name in self.shorts[short]:
                    if whole <= size:
                        names.add(name)
                        covered = max(covered, whole)
                short = self.short_state[link[short]]
            if covered:
                first = i + 1 - covered
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        for s in states:
            names |= self.items.get(s, set())
        return spans, names


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def _stream(held, cut: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = held.value
        for batch in batches:
            texts, sizes, spans, items = [], [], [], []
            for text, had, names in zip(batch["text"], batch["spans"], batch["items"], strict=True):
                words = words_of(text)
                found, owners = automaton.match(words)
                if len(had):
                    found = _merge([list(map(int, s)) for s in had] + found)
                sizes.append(len(words))
                spans.append(found)
                items.append(sorted({*names, *owners}))
                texts.append(cut_spans(text, found) if cut and found else text)
            yield batch.assign(text=texts, n_words=sizes, spans=spans, items=items)

    return run


def match_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """`docs` (text and any columns) with n_words, n_hit, spans, items and contaminated appended.

    spans: arrays [first word, end word) of hit words; items: sorted ids as strings. Input
    columns with one of these names are replaced.
    """
    return _matched(docs, benchmark, window, percent, block_words, cut=False)


def _matched(docs: DataFrame, benchmark: DataFrame, window: int, percent: int, block_words: int, cut: bool) -> DataFrame:
    spark = docs.sparkSession
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    named = named.where("item_id is not null and text is not null").distinct()
    letters = named.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(letters / 6 / block_words))
    named = named.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "spans", "items", "contaminated")]
    out = docs.select(
        *kept,
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<array<int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        rows = named.where(F.col("block") == block).select("item_id", "text").collect()
        automaton = ItemAutomaton(sorted((r.item_id, words_of(r.text)) for r in rows), window)
        if block:  # one automaton in a task's memory at a time
            out = written(out)
        last = block == blocks - 1
        out = out.mapInPandas(_stream(spark.sparkContext.broadcast(automaton), cut and last), out.schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return (
        out.withColumn("n_hit", hit)
        .withColumn("contaminated", F.expr(f"n_hit > 0 and 100 * n_hit >= {percent} * n_words"))
        .select(*kept, "n_words", "n_hit", "spans", "items", "contaminated")
    )


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the hit words and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """`docs` without contaminated rows; of the others, hit spans are cut out of the text. Same columns."""
    used = [c for c in ("text", "n_chars") if c in docs.columns]
    out = _matched(masked(docs, *used), benchmark, window, percent, block_words, cut=True).where("not contaminated")
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, size).otherwise(F.col("n_chars")))
    return unmasked(out, docs.columns, *used)
