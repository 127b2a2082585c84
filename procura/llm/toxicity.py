"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A document is a bag of sentences. A sentence holding words of the model is toxic with
probability sigmoid(bias + sum of its words' weights), one without any with probability 0,
and a document is toxic if any of its sentences is or if a leak, the same for every
document, makes it so: P = 1 - (1 - leak) * product of (1 - p). This noisy-or is what the
document labels are fitted to, by gradient steps scaled with the diagonal of the Fisher
information, each of which sends one number per weight to the driver. So a length alone
never makes a document toxic, and the sentences that do are located.

The words of the model are those that stand in different contexts (the word before and the
word after) of toxic documents far more often than in contexts of others: by log odds of at
least LEAST_ODDS and a log likelihood ratio of at least EVIDENCE. Contexts are counted once,
however many copies of a document are labelled.

Fitted on labelled documents of at most `fit_docs` ids, those with the smallest hashes, and
on at most `most_words` words, those with the most evidence. Scores cover whole texts.

Defined cases: null text or text without words is scored by the leak alone. Without labels
to learn from the leak is 0. A null label is none; of repeated labels of a document the
largest counts; a label of a null doc_id is ignored. Repeated rows come back as often as
they came in. Other columns are kept by `score` unless it writes one of the same name, and
ignored by `predictions`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from procura.llm.common import free_name, written

FIT_DOCS = 6000
MOST_WORDS = 1000
LEAST_ODDS = 1.5
EVIDENCE = 20.0
PRIOR = 0.05
STEPS = 40
ENOUGH = 1e-4
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_SENTENCE = re.compile(r"[^.!?\n]+")
_SPANS = ArrayType(StructType().add("start", "integer").add("end", "integer").add("score", "double"))


def _learned_from(rate: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % rate != 0, F.lit(False))


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
            words = [".", *_TOKEN.findall(text.lower()), "."]
            found = {(w, zlib.crc32(f"{a} {b}".encode())) for a, w, b in zip(words, words[1:], words[2:]) if w.isalpha()}
            yield pd.DataFrame(found, columns=["word", "context"]).assign(toxic=bool(toxic))


def model_words(labelled: DataFrame, most: int = MOST_WORDS) -> dict[str, float]:
    """Words that mark toxic documents with their log odds, from rows (toxic, text)."""
    contexts = labelled.mapInPandas(_contexts, "word string, context long, toxic boolean").distinct()
    counts = contexts.groupBy("word").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    counts = written(counts)
    total = counts.agg(F.sum("a"), F.sum("b")).first()
    a_all, b_all = float(total[0] or 0), float(total[1] or 0)
    if not a_all or not b_all:
        return {}
    odds = F.log((F.col("a") + 0.5) / (a_all + 1)) - F.log((F.col("b") + 0.5) / (b_all + 1))
    both, share = F.col("a") + F.col("b"), a_all / (a_all + b_all)
    part = lambda n, s: F.when(n > 0, n * F.log(n / (both * s))).otherwise(0.0)
    evidence = 2 * (part(F.col("a"), share) + part(F.col("b"), 1 - share))
    rows = counts.select("word", odds.alias("odds"), evidence.alias("evidence"))
    rows = rows.where((F.col("odds") >= LEAST_ODDS) & (F.col("evidence") >= EVIDENCE))
    return {r.word: r.odds for r in rows.orderBy(F.desc("evidence"), "word").limit(most).collect()}


def _sentences(text: str, number: dict[str, int]) -> list[tuple[int, int, list[int]]]:
    """(start, end, word numbers) of the sentences that hold words of the model."""
    low = text.lower()
    if number.keys().isdisjoint(_WORD.findall(low)):
        return []
    out = []
    for m in _SENTENCE.finditer(text):
        held = sorted({number[w] for w in _WORD.findall(m.group().lower()) if w in number})
        if held:
            out.append((m.start(), m.end(), held))
    return out


def _bags(words: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {w: i for i, w in enumerate(words)}
        for batch in batches:
            bags = [[held for _, _, held in _sentences(text, number)] for text in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "sentences": bags})

    return run


class ToxicWords:
    """Weights of the model: words, then the sentences' bias, then the documents' leak."""

    def __init__(self, words: list[str], weights: np.ndarray):
        self.number = {w: i for i, w in enumerate(words)}
        self.weights = weights

    def chance(self, held: list[int]) -> float:
        return _sigmoid(self.weights[held].sum() + self.weights[-2])

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its sentences (start, end, score) of model words."""
        spans = [(s, e, self.chance(held)) for s, e, held in _sentences(text or "", self.number)]
        clean = 1 - _sigmoid(self.weights[-1])
        for _, _, p in spans:
            clean *= 1 - p
        return 1 - clean, spans


def _sigmoid(z: float) -> float:
    return 0.0 if z == -math.inf else 1 / (1 + math.exp(-max(-30.0, min(30.0, float(z)))))


def _slopes(weights: np.ndarray):
    """Loss, gradient and diagonal of the Fisher information, summed over a partition's bags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, slope, fisher = 0.0, np.zeros(len(weights)), np.zeros(len(weights))
        leak = _sigmoid(weights[-1])
        for batch in batches:
            for toxic, sentences, n in zip(batch["toxic"], batch["sentences"], batch["n"], strict=True):
                clean, moved = math.log1p(-leak), {len(weights) - 1: leak}
                for held in sentences:
                    p = _sigmoid(weights[held].sum() + weights[-2])
                    clean += math.log1p(-p)
                    for j in (*held, len(weights) - 2):
                        moved[j] = moved.get(j, 0.0) + p
                whole = max(-math.expm1(clean), 1e-12)
                odds = (1 - whole) / whole
                loss -= n * (math.log(whole) if toxic else clean)
                for j, p in moved.items():  # -d log(clean) / d weight j is p
                    slope[j] += n * (-odds * p if toxic else p)
                    fisher[j] += n * odds * p * p
        yield pd.DataFrame({"loss": [loss], "slope": [slope.tolist()], "fisher": [fisher.tolist()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, most_words: int = MOST_WORDS) -> ToxicWords:
    """The model learned from `docs` (doc_id, text) and `labels` (doc_id, toxic) outside the held-out fifth."""
    known = labels.where(F.col("toxic").isNotNull() & _learned_from()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most fit_docs rows
    rows = written(rows.select((F.col("toxic") == 1).alias("toxic"), "text"))
    found = model_words(rows, most_words)
    words = sorted(found)
    bags = rows.mapInPandas(_bags(words), "toxic boolean, sentences array<array<int>>")
    bags = written(bags.groupBy("toxic", "sentences").agg(F.count(F.lit(1)).alias("n")))
    plain = {r.toxic: r.n for r in bags.where("size(sentences) = 0").collect()}
    share = plain.get(True, 0) / max(1, sum(plain.values()))
    weights = np.array([*(min(found[w], 4.0) for w in words), -2.0, math.log((share + 1e-4) / (1 - share + 1e-4))])
    if bags.isEmpty():
        return ToxicWords(words, np.where(np.arange(len(weights)) < len(weights) - 1, weights, -math.inf))

    def measure(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = bags.mapInPandas(_slopes(w), "loss double, slope array<double>, fisher array<double>").collect()
        pull = PRIOR * np.where(np.arange(len(w)) < len(words), w, 0)  # a row per partition of at most fit_docs bags
        loss = sum(p.loss for p in parts) + float((pull * w).sum()) / 2
        return loss, sum(np.array(p.slope) for p in parts) + pull, sum(np.array(p.fisher) for p in parts) + PRIOR

    loss, slope, fisher = measure(weights)
    rate = 0.5
    for _ in range(STEPS):
        trial = weights - rate * (slope / fisher).clip(-2, 2)
        now = measure(trial)
        if now[0] > loss:
            rate /= 2
            if rate < 0.01:
                break
            continue
        gain = loss - now[0]
        weights, (loss, slope, fisher) = trial, now
        rate = min(1.0, rate * 1.2)
        if gain < ENOUGH * max(1.0, loss):
            break
    return ToxicWords(words, weights)


def _score(held, kept: list[str], text: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for batch in batches:
            found = [model.judge(t) for t in batch[text]]
            spans = [[{"start": s, "end": e, "score": p} for s, e, p in own] for _, own in found]
            yield batch[kept].assign(score=[p for p, _ in found], sentences=spans)

    return run


def score(docs: DataFrame, model: ToxicWords, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """`docs` (or its columns `keep`) with score and sentences: (start, end, score) in characters of those with model words."""
    kept = [c for c in keep or docs.columns if c not in ("score", "sentences")]
    free = free_name("_text", docs.columns)
    rows = docs.select(*kept, F.col(text).alias(free))
    schema = rows.select(*kept).schema.add("score", "double").add("sentences", _SPANS)
    return rows.mapInPandas(_score(docs.sparkSession.sparkContext.broadcast(model), kept, free), schema)


def predictions(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_toxic_sentences) of every row of `docs`."""
    found = score(docs.select("doc_id", "text"), fit(docs, labels, **how), keep=["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size(F.filter("sentences", lambda s: s["score"] >= 0.5)).alias("n_toxic_sentences"),
    )
