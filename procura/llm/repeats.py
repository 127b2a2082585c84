"""Removal of long passages that already occur in a document with a smaller id.

Every window of `length` consecutive words is hashed by Rabin and Karp's method: prefix
sums of word hash times base power, modulo 2 ** 64, give the hash of any window at once.
A window is removed if the same words start somewhere in a document with a smaller doc_id;
removed windows merge into maximal intervals.

To shuffle little, windows are dealt out in runs. Each window names as its anchor the
least hashed of its short word groups, so equal windows name equal anchors, and windows
next to each other mostly name the same one: those are a run. An anchor that only one
document holds settles its windows at once. A run whose whole word sequence also occurs in
a smaller document is removed as a whole. Only the windows of the remaining runs are
counted one by one, with 128 bits of hash. This loses nothing: the smallest holder of a
run always keeps its windows in that count. Texts with equal copies are judged once.

Defined cases: null text has no words; a text of fewer words than a window keeps all of
them. A null doc_id is never smaller than another and never has a smaller one, so its row
keeps its words. Rows sharing a doc_id do not remove from each other. Repeated rows come
back as often as they came in. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.common import written
from procura.llm.textcode import chunks, mix64, powers, word_hashes

LENGTH = 50
GROUP = 10
_BASE = 0xC6A4A7935BD1E995
_INVERSE = pow(_BASE, -1, 2**64)
_SECOND = np.uint64(0x2545F4914F6CDD1D)
_PLACE = np.uint64((1 << 24) - 1)
NOTHING = hashlib.sha256(b"").hexdigest()


def text_key(code: bytes) -> bytes:
    return hashlib.blake2b(code, digest_size=16).digest()


class Rolling:
    """Hashes of any word range of a run of texts; ranges must stay inside one text."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(words * powers(_BASE, self.n), out=self.sums[1:])
        self.back = powers(_INVERSE, self.n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start])


def window_runs(words: np.ndarray, bounds: np.ndarray, length: int, group: int):
    """Runs of windows of the texts that `bounds` cuts `words` into.

    Returns (first window start, last window start, anchor hash, run hash) for each run.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(words) < length:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    rolling = Rolling(words)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(words) - group + 1)
    grams = rolling(at, at + group)
    # order by hash, then place: the leftmost of equal groups in every window
    place = (at - bounds[text[at]]).astype(np.uint64)
    least = (grams & ~_PLACE) | (place & _PLACE)
    span, have = length - group + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    start = np.flatnonzero(text[: len(words) - length + 1] == text[length - 1 :])
    if not len(start):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    # places are kept modulo _PLACE + 1, more than a window has groups, so one of them is in the window
    anchor = start + ((least[start] - place[start]) & _PLACE).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    low, high, anchor = start[first], start[last], anchor[first]
    whole = rolling(low, high + length)
    run = mix64(whole + (anchor - low).astype(np.uint64) * _SECOND + (high - low).astype(np.uint64))
    return low, high, grams[anchor], run


def _sign(length: int, group: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].tolist()
            for begin, end, encoded in chunks(batch["text"].tolist()):
                words, bounds = word_hashes(encoded, lower=False)
                low, _, anchor, runs = window_runs(words, bounds, length, group)
                cut = np.searchsorted(low, bounds)
                anchor, runs = anchor.view(np.int64), runs.view(np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(ids[begin:end], dtype="Int64"),
                        "key": [text_key(code) for code in encoded],
                        "n_words": np.diff(bounds),
                        "whole": [hashlib.sha256(b" ".join(code.split())).hexdigest() for code in encoded],
                        "anchors": [anchor[a:b] for a, b in zip(cut, cut[1:])],
                        "runs": [runs[a:b] for a, b in zip(cut, cut[1:])],
                    }
                )

    return run


def _windows(length: int, group: int):
    """The single windows of the runs that are still open, with both hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                code = (row.text or "").encode("utf-8")
                if text_key(code) != row.key:
                    continue
                words, bounds = word_hashes([code], lower=False)
                low, high, _, runs = window_runs(words, bounds, length, group)
                open_runs = np.isin(runs.view(np.int64), np.asarray(row.open, dtype=np.int64))
                if not open_runs.any():
                    continue
                at = np.concatenate([np.arange(a, b + 1) for a, b in zip(low[open_runs], high[open_runs])])
                one, two = Rolling(words)(at, at + length), Rolling(mix64(words ^ _SECOND))(at, at + length)
                yield pd.DataFrame(
                    {"doc_id": row.doc_id, "key": row.key, "at": at, "h1": one.view(np.int64), "h2": two.view(np.int64)}
                )

    return run


def _cut(length: int, group: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                code = (row.text or "").encode("utf-8")
                if text_key(code) != row.key:
                    continue
                words, bounds = word_hashes([code], lower=False)
                low, high, _, runs = window_runs(words, bounds, length, group)
                gone = np.isin(runs.view(np.int64), np.asarray(row.settled, dtype=np.int64))
                step = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(step, low[gone], 1)
                np.add.at(step, high[gone] + length, -1)
                if row.hits is not None:
                    hits = np.asarray(row.hits, dtype=np.int64)
                    np.add.at(step, hits, 1)
                    np.add.at(step, hits + length, -1)
                removed = np.cumsum(step[:-1]) > 0
                kept = " ".join(w.decode("utf-8") for w, r in zip(code.split(), removed) if not r)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], removed.view(np.int8), [0]))))
                out.append((row.doc_id, row.key, int(removed.sum()), kept, edge.tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "key", "n_removed", "kept", "removed"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, removed) for every row of `docs` (doc_id, text).

    `kept` is the text of the kept words joined by one space, null where nothing was
    removed or, with `texts` false, everywhere; `removed` lists the interval bounds, in words.
    """
    group = min(group, length)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(
        base.mapInPandas(
            _sign(length, group),
            "doc_id long, key binary, n_words long, whole string, anchors array<long>, runs array<long>",
        )
    )
    first = signed.groupBy("key").agg(F.min("doc_id").alias("first"))
    own = signed.join(first, "key").where("doc_id = first and size(runs) > 0")
    runs = own.select("doc_id", "key", F.explode(F.arrays_zip("anchors", "runs")).alias("r"))
    runs = runs.select("doc_id", "key", F.col("r.anchors").alias("anchor"), F.col("r.runs").alias("run"))
    repeated = runs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    held = written(runs.join(repeated.select("anchor"), "anchor"))
    holder = held.groupBy("anchor", "run").agg(F.min("doc_id").alias("holder"))
    state = held.join(holder, ["anchor", "run"]).groupBy("doc_id", "key").agg(
        F.collect_set(F.when(F.col("holder") < F.col("doc_id"), F.col("run"))).alias("settled"),
        F.collect_set(F.when(F.col("holder") == F.col("doc_id"), F.col("run"))).alias("open"),
    )
    state = written(state)
    windows = written(
        base.join(state.where("size(open) > 0").select("doc_id", "key", "open"), "doc_id").mapInPandas(
            _windows(length, group), "doc_id long, key binary, at long, h1 long, h2 long"
        )
    )
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    hits = windows.join(least, ["h1", "h2"]).where("least < doc_id").groupBy("doc_id", "key").agg(F.collect_set("at").alias("hits"))
    doomed = state.drop("open").join(hits, ["doc_id", "key"], "left").where("size(settled) > 0 or hits is not null")
    cut = base.join(doomed, "doc_id").mapInPandas(
        _cut(length, group), "doc_id long, key binary, n_removed long, kept string, removed array<int>"
    )
    if not texts:
        cut = cut.withColumn("kept_sha256", F.sha2("kept", 256)).withColumn("kept", F.lit(None).cast("string"))
    else:
        cut = cut.withColumn("kept_sha256", F.sha2("kept", 256))
    cut = cut.groupBy("doc_id", "key").agg(*(F.first(c).alias(c) for c in ("n_removed", "kept_sha256", "kept", "removed")))
    copy = F.col("doc_id").isNotNull() & (F.col("first") < F.col("doc_id")) & (F.col("n_words") >= length)
    whole = F.array(F.lit(0), F.col("n_words").cast("int"))
    return (
        signed.select("doc_id", "key", "n_words", "whole")
        .join(first, "key")
        .join(cut, ["doc_id", "key"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
            F.when(copy, F.lit("") if texts else F.lit(None)).otherwise(F.col("kept")).alias("kept"),
            F.when(copy, whole).otherwise(F.coalesce("removed", F.array().cast("array<int>"))).alias("removed"),
        )
    )
