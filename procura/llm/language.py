"""Language identification by prediction by partial matching.

For each language a context tree over the last ORDER bytes holds how often which byte
followed. A byte's probability comes from the longest context known; a byte not seen there
escapes to the next shorter one with probability seen / (total + seen), bytes already
excluded do not count again, and the last resort is uniform over the bytes left (method C
with exclusions). The code length of a text is the sum of -log2 of these; statistics are
frozen, so a context's code lengths are tables. All languages share one automaton whose
states are the longest known contexts, and whole texts run through it, many pieces side by
side; each piece first reads ORDER bytes of its predecessor, which fixes its state exactly.

The language with the shortest code wins, ties go to the smaller name; the score is its
posterior under equal priors.

Fitted on at most `fit_docs` documents per language (smallest id hashes), of those whose
crc32(doc_id) mod 3 is not 1. The automaton keeps at most about `max_states` contexts.

A document of a language that was not learned, or of noise, also has a nearest language.
`accepted` tells it by its code: the letters of the text alone, small, joined by one blank
where others stood between, must in some learned language take at most STRANGE times the
bits a byte that documents labelled with that language take at their median, all of them
counted, and SHORT_BITS more whatever the length, so that a text too short to tell stays.
Words of up to 64 characters with a digit or @ (keys, numbers, addresses) say nothing about
the language and are left out where other letters remain.

Defined cases: null text or text without a letter is `und` with score 0, and so is
everything if nothing can be learned. A null doc_id is not held out and not learned from.
Repeated rows come back as often as they came in. Other columns are ignored or kept as the
function says.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from procura.llm.common import free_name, small_batches, written
from procura.llm.textcode import column_chunks

ORDER = 3
FIT_DOCS = 200
MAX_STATES = 6000
PIECE = 512
STRANGE = 2.5
SHORT_BITS = 100.0
UNKNOWN = "und"


def least_count(ranked: list[int], max_states: int) -> int:
    """How often a context must occur so that at most `max_states` do, from the largest counts."""
    return max(2, ranked[max_states] + 1 if len(ranked) > max_states else 2)


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            code = text.encode("utf-8")
            for size in range(1, ORDER + 2):
                counts.update((lang, code[i : i + size]) for i in range(len(code) - size + 1))
    yield pd.DataFrame([(lang, gram, n) for (lang, gram), n in counts.items()], columns=["lang", "gram", "n"])


class ContextTrees:
    """Code length tables of all languages over one automaton of contexts."""

    def __init__(self, rows: list[tuple[str, bytes, int]], max_states: int = MAX_STATES, least: int | None = None):
        """`rows` are (language, gram, count); with `least` they may lack grams whose context occurs less often."""
        self.langs = sorted({lang for lang, _, _ in rows})
        known = sorted({gram[0] for _, gram, _ in rows if len(gram) == 1})
        self.symbol = np.full(256, len(known), dtype=np.int16)
        self.symbol[known] = np.arange(len(known))
        self.pad = len(known) + 1
        total: Counter = Counter()
        for _, gram, n in rows:
            if len(gram) <= ORDER:
                total[gram] += n
        # an occurrence threshold keeps the contexts closed under dropping either end
        least = least or least_count(sorted(total.values(), reverse=True)[: max_states + 1], max_states)
        contexts = [b"", *sorted(g for g, n in total.items() if n >= least)]
        state = {c: i for i, c in enumerate(contexts)}
        after = [dict() for _ in self.langs]
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, n in rows:
            if gram[:-1] in state:
                own = after[at[lang]].setdefault(gram[:-1], np.zeros(len(known)))
                own[self.symbol[gram[-1]]] += n
        self.step = np.zeros((len(contexts), self.pad + 1), dtype=np.int32)
        self.bits = np.zeros((len(contexts), self.pad + 1, len(self.langs)), dtype=np.float32)
        for c, i in state.items():
            for s, byte in enumerate(known):
                to = c + bytes([byte])
                while to not in state:
                    to = to[1:]
                self.step[i, s] = state[to]
            for k, own in enumerate(after):
                self.bits[i, : self.pad, k] = self._lengths([own.get(c[j:]) for j in range(len(c) + 1)], len(known))

    @staticmethod
    def _lengths(chain: list[np.ndarray | None], known: int) -> np.ndarray:
        """-log2 of each symbol's probability, longest context first; the last entry is any unknown byte."""
        p, out, weight = np.zeros(known + 1), np.zeros(known, dtype=bool), 1.0
        for counts in chain:
            if counts is None:
                continue
            seen = np.where(out, 0, counts)
            kinds, total = np.count_nonzero(seen), seen.sum()
            if kinds:
                p[:known] += weight * seen / (total + kinds)
                weight *= kinds / (total + kinds)
                out |= seen > 0
        left = weight / max(1, 256 - out.sum())
        p[:known][~out] = left
        p[known] = left
        return -np.log2(p)

    def code_lengths(self, encoded: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        sizes = np.array([len(c) for c in encoded])
        data = np.full(sizes.sum() + ORDER + PIECE + 1, self.pad, dtype=np.int16)
        data[ORDER : ORDER + sizes.sum()] = self.symbol[np.frombuffer(b"".join(encoded), dtype=np.uint8)]
        first = np.cumsum(sizes) - sizes + ORDER
        pieces = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), pieces)
        place = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[text] + place * PIECE
        size = np.minimum(PIECE, sizes[text] - place * PIECE)
        order = np.argsort(-size, kind="stable")
        text, start, size, place = text[order], start[order], size[order], place[order]
        states = np.zeros(len(text), dtype=np.int64)
        for back in range(ORDER, 0, -1):
            states = self.step[states, np.where(place > 0, data[start - back], self.pad)]
        bits = np.zeros((len(text), len(self.langs)))
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            symbols, here = data[start[:live] + t], states[:live]
            bits[:live] += self.bits[here, symbols]
            states[:live] = self.step[here, symbols]
        out = np.zeros((len(sizes), len(self.langs)))
        np.add.at(out, text, bits)
        return out


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS, max_states: int = MAX_STATES) -> ContextTrees | None:
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text", "lang").where(
        "text is not null and lang is not null and crc32(cast(id as binary)) % 3 <> 1"
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fit_docs)
    spread = few.select("lang", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = written(spread.mapInPandas(_grams, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counted = counted.where("n > 1")
    total = counted.where(F.length("gram") <= ORDER).groupBy("gram").agg(F.sum("n").alias("n"))
    ranked = [r.n for r in total.select("n").orderBy(F.desc("n")).limit(max_states + 1).collect()]
    if not ranked:
        return None
    least = least_count(ranked, max_states)
    contexts = total.where(F.col("n") >= least).select(F.col("gram").alias("context"))  # at most max_states
    context = F.col("gram").substr(F.lit(1), F.length("gram") - 1)
    used = counted.where(F.length("gram") == 1).unionAll(
        counted.where(F.length("gram") > 1).withColumn("context", context).join(F.broadcast(contexts), "context").select(counted.columns)
    )
    found = used.toArrow()  # at most 256 per context and language
    columns = (found.column(c).to_pylist() for c in ("lang", "gram", "n"))
    return ContextTrees(list(zip(*columns, strict=True)), max_states, least)


def _judged(trees: ContextTrees, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest language, its posterior and its bits for each text."""
    bits = trees.code_lengths(encoded)
    least = bits.min(axis=1)
    scores = 1 / np.exp2(-(bits - least[:, None]).clip(0, 1000)).sum(axis=1)
    return np.array(trees.langs, dtype=object)[bits.argmin(axis=1)], scores, least


def _predict(held, text: int, mark: int, kept: int):
    """The first `kept` columns with language, score and bits; columns go by place, so names do not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in batches:
            lettered = np.asarray(batch.column(mark).to_numpy(zero_copy_only=False), dtype=bool)
            for first, end, encoded in column_chunks(batch.column(text)):
                names, scores, bits = _judged(trees, encoded)
                known = lettered[first:end]
                new = [
                    pa.array(np.where(known, names, UNKNOWN), pa.string()),
                    pa.array(np.where(known, scores, 0.0)),
                    pa.array(np.where(known, bits, 0.0)),
                ]
                own = [batch.column(i).slice(first, end - first) for i in range(kept)]
                yield pa.RecordBatch.from_arrays(own + new, names=[*batch.schema.names[:kept], "lang_pred", "score", "code_bits"])

    return run


def identify(docs: DataFrame, trees: ContextTrees | None, keep: list[str] | None = None, held=None) -> DataFrame:
    """`docs` with lang_pred, score and code_bits (of the chosen language); same-named columns are replaced.

    With `keep`, only these columns of `docs` come back. `held` is a broadcast of `trees`, if there is one already.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "code_bits")]
    if trees is None:
        none = F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("code_bits")
        return docs.select(*kept, *none)
    text, mark = free_name("_text", docs.columns), free_name("_lettered", docs.columns)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*kept, F.col("text").alias(text), lettered.alias(mark))
    schema = StructType([*docs.select(*kept).schema.fields, StructField("lang_pred", StringType())])
    schema.add("score", DoubleType()).add("code_bits", DoubleType())
    held = held or docs.sparkSession.sparkContext.broadcast(trees)
    return rows.mapInArrow(_predict(held, len(kept), len(kept) + 1, len(kept)), schema)


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs` (doc_id, text, lang)."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = identify(docs.select("doc_id", "text"), learn(docs), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _letters(text: Column) -> Column:
    """The letters of a text, small, with one blank for whatever stands between."""
    words = F.regexp_replace(text, r"(?<!\S)(?=\S{0,63}[0-9@])\S{1,64}(?!\S)", " ")
    said = F.when(words.rlike(r"\p{L}"), words).otherwise(text)
    return F.lower(F.trim(F.regexp_replace(said, r"[^\p{L}\p{M}]+", " ")))


def usual_rates(docs: DataFrame, trees: ContextTrees, held=None) -> dict[str, float]:
    """Median bits a byte of the letters of each language's labelled documents; one number a language reaches the driver."""
    rows = docs.where("lang is not null").select("lang", _letters(F.col("text")).alias("text"))
    rows = rows.withColumn("size", F.octet_length("text")).where("size > 0")
    own = identify(rows, trees, keep=["lang", "size"], held=held).where("lang_pred = lang")
    rates = own.groupBy("lang").agg(F.percentile_approx(F.col("code_bits") / F.col("size"), 0.5).alias("rate"))
    return {r.lang: r.rate for r in rates.collect()}


def _accept(held, width: int, lang: int, text: int, rates: list[float], least_score: float):
    """The first `width` columns of the rows that pass, with the language put in column `lang`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in batches:
            for first, end, encoded in column_chunks(batch.column(text)):
                names, scores, _ = _judged(trees, encoded)
                part = batch.slice(first, end - first)
                beyond = np.empty(end - first)
                for at, to, letters in column_chunks(part.column(width)):
                    sizes = np.array([len(code) for code in letters])
                    beyond[at:to] = (trees.code_lengths(letters) - STRANGE * np.outer(sizes, rates)).min(axis=1)
                own = [part.column(i) for i in range(width)]
                own[lang] = pa.array(names, batch.schema.types[lang])
                passed = pa.array((scores >= least_score) & (beyond <= SHORT_BITS))
                yield pa.RecordBatch.from_arrays(own, names=batch.schema.names[:width]).filter(passed)

    return run


def accepted(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Rows whose language is known, with `lang` set to it; the columns of `docs`.

    If nothing can be learned, no language is known and no row comes back. The rows are
    written here, because Arrow batches are smaller than the session's while they are made.
    """
    trees = learn(docs)
    if trees is None:
        return docs.limit(0)
    held = docs.sparkSession.sparkContext.broadcast(trees)
    with small_batches(docs.sparkSession):
        rates = usual_rates(docs, trees, held)
    # a language without a labelled document found to be its own is held to the most any other takes
    bounds = [rates.get(lang, max(rates.values(), default=float("inf"))) for lang in trees.langs]
    rows = docs.where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn(free_name("_letters", docs.columns), _letters(F.col("text")))
    columns = docs.columns
    passing = _accept(held, len(columns), columns.index("lang"), columns.index("text"), bounds, least_score)
    with small_batches(docs.sparkSession):
        found = written(rows.mapInArrow(passing, rows.select(*columns).schema))
    held.destroy()  # the driver keeps no table of what is written now
    return found
