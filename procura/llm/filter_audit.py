"""Filter interaction audit with truth-table survival words.

A document fails some of up to five filters. Its survival word has one bit for each of the
32 subsets of filters: bit s is set when no filter of subset s removes the document. Words
are counted position by position with carry-save adders: three words become a sum word and
a carry word of twice the weight, until few words are left of each weight. So each bit of
the total is the number of documents that survive that subset, for every part and label
class, and all orders of the filters are read from these 32 numbers: what stays after a
step is the count of the subset of filters applied so far.

Counting happens within the tasks; one row for each part and subset leaves a task. Equal
texts meet by a digest, of which only the smallest id of repeated texts is joined back, so
a text or a part with many rows costs no more than others.

Defined cases: null text is an empty text, and all empty texts are equal; a null part is the
empty string. A null doc_id is neither smaller than another nor larger, and has no label;
rows that share a doc_id and a text are no copies of a smaller id. Of repeated labels of a
document each counts that is 1 in any row; null labels count as 0. Repeated rows count as
often as they come. An empty table has no parts and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.llm.common import written

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
MARKS = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))


def survival_words(filters: int) -> np.ndarray:
    """The survival word of each set of failed filters."""
    sets = np.arange(1 << filters, dtype=np.uint32)
    alive = (sets[:, None] & sets[None, :]) == 0
    return (alive.astype(np.uint32) << sets[None, :]).sum(axis=1, dtype=np.uint64).astype(np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set."""
    counts, weight = np.zeros(32, dtype=np.int64), 1
    while len(words):
        carried = []
        while len(words) >= 3:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            either = a ^ b
            carried.append((a & b) | (either & c))
            words = np.concatenate([either ^ c, words[3 * third :]])
        counts += weight * ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64)
        words = np.concatenate(carried) if carried else words[:0]
        weight *= 2
    return counts


def _failed(code: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = code.split()
    capitals = len(code) - len(code.translate(None, _CAPITALS))
    points = len(code.translate(None, _CONTINUED))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS_PERCENT * points) << 2
        | (len(code.translate(None, MARKS)) < len(code)) << 3
    )


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        failed, keys = [], []
        for text in batch.column("text").cast(pa.large_binary()):
            code = text.as_py() or b""
            failed.append(_failed(code))
            keys.append(hashlib.blake2b(code, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(failed, pa.int32()), pa.array(keys, pa.binary())],
            names=["doc_id", "part", "failed", "text_key"],
        )


def text_filters(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) of every row of `docs` (doc_id, text, source).

    failed has bit 0 for under 200 words, 1 for under half distinct words, 2 for over two
    percent capitals, 3 for any of the marks and 4 for the text of a smaller doc_id.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text"
    )
    judged = written(rows.mapInArrow(_judge, "doc_id long, part string, failed int, text_key binary"))
    # written, so that the join reads plain shuffles and the rows of a hot text can be split
    first = written(
        judged.groupBy("text_key")
        .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .where("first_id < last_id")
        .drop("last_id")
    )
    copy = F.when(F.col("doc_id") > F.col("first_id"), 16).otherwise(0)
    return judged.join(first, "text_key", "left").select("doc_id", "part", F.col("failed").bitwiseOR(copy).alias("failed"))


def _survivors(filters: int):
    subsets = 1 << filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = survival_words(filters)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").dictionary_encode()
            words = table[batch.column("failed").to_numpy()]
            label = batch.column("label").to_numpy()
            group = parts.indices.to_numpy() * 4 + label
            order = np.argsort(group, kind="stable")
            names, at = np.unique(group[order], return_index=True)
            counts = np.array([positional_counts(w)[:subsets] for w in np.split(words[order], at[1:])])
            label = np.repeat(names % 4, subsets)
            n = counts.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    parts.dictionary.take(pa.array(np.repeat(names // 4, subsets))),
                    pa.array(np.tile(np.arange(subsets, dtype=np.int32), len(names))),
                    pa.array(n),
                    pa.array(np.where(label & 1, n, 0)),
                    pa.array(np.where(label & 2, n, 0)),
                ],
                names=["part", "subset", "n", "n_good", "n_toxic"],
            )

    return run


def subset_survivors(failed: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, subset, n, n_good, n_toxic) from rows (part, failed, label): survivors of every subset of filters.

    label has bit 0 for good quality and bit 1 for toxic.
    """
    columns = failed.select(F.coalesce("part", F.lit("")).alias("part"), F.col("failed").cast("int"), F.col("label").cast("int"))
    counted = columns.mapInArrow(_survivors(filters), "part string, subset int, n long, n_good long, n_toxic long")
    return counted.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")))


def _at(counts: str, subset: Column) -> Column:
    return F.element_at(counts, subset + 1)


def orders_report(survivors: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each step of each order of the filters does in each part; `filters` names them by one letter each."""
    k, every = len(filters), (1 << len(filters)) - 1
    per_part = survivors.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "n_good", "n_toxic"))).alias("all"))
    arrays = {"n": "n", "good": "n_good", "bad": "n_toxic"}
    per_part = per_part.select("part", *(F.col("all")[field].alias(name) for name, field in arrays.items()))
    shares = []
    for f in range(k):
        share = F.lit(0).cast("long")
        for s in (s for s in range(every + 1) if not s >> f & 1):
            size = s.bit_count()
            removed = _at("n", F.lit(s)) - _at("n", F.lit(s | 1 << f))
            share += math.factorial(size) * math.factorial(k - 1 - size) * removed
        shares.append(share)
    names = ",".join("".join(p) for p in permutations(filters))
    steps = (
        per_part.withColumn("shares", F.array(*shares))
        .withColumn("filter_order", F.explode(F.split(F.lit(names), ",")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    )
    place = F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    before = F.expr(
        f"aggregate(sequence(1, {k}), 0, (s, i) -> "
        f"s + if(i < step, shiftleft(1, instr('{filters}', substring(filter_order, i, 1)) - 1), 0))"
    )
    steps = steps.withColumn("place", place).withColumn("before", before)
    steps = steps.withColumn("bit", F.expr("shiftleft(1, place)")).withColumn("after", F.col("before") + F.col("bit"))
    removed = _at("n", F.col("before")) - _at("n", F.col("after"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        _at("n", F.col("after")).alias("kept"),
        removed.alias("removed"),
        (_at("n", F.lit(0)) - _at("n", F.col("bit")) - removed).alias("redundant"),
        (_at("n", F.lit(every) - F.col("bit")) - _at("n", F.lit(every))).alias("unique_fails"),
        (_at("good", F.col("before")) - _at("good", F.col("after"))).alias("good_lost"),
        (_at("bad", F.col("before")) - _at("bad", F.col("after"))).alias("toxic_lost"),
        F.element_at("shares", F.col("place") + 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five text filters and step, zeros included."""
    good, bad = (F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")) for c in ("quality", "toxic"))
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = written(marks.agg((good + 2 * bad).alias("label")))
    failed = text_filters(docs).join(marks, "doc_id", "left")
    return orders_report(subset_survivors(failed.withColumn("label", F.coalesce("label", F.lit(0)))))
