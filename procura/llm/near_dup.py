"""Near-duplicate components of documents with circulant MinHash.

A document is the set of its distinct `words`-word shingles, hashed to 64 bits. One
permutation of a 32-bit universe scatters the shingles, a second one, shifted circularly
by k, gives coordinate k of the signature as its minimum. Bands of coordinates propose
candidates; a link counts only after the Jaccard similarity of the full sets was computed.

Equal sets are collapsed to one node before banding, so copies never pair up. Within a
bucket not all pairs are formed. First every member is compared with the smallest node of
its bucket; links are contracted to components, and buckets that have become one component
are done. In the others every member
is compared with the best linked node of the largest component, the pivot. Pairs of its
members that could still link must share much of what tells them from the pivot; an exact
prefix filter over those differences (`_close`) finds them, and they are compared too. So
every candidate pair is compared, connected, or ruled out by a bound.

Defined cases: null or empty text, or text without words, has an empty set, is linked with
nothing and is its own component. A text of fewer words is one shingle. Rows with a null
doc_id take part; their component is the smallest non-null id reachable, else null. Rows
that share a doc_id keep their own sets. Repeated rows come back as often as they came in.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.llm.common import components, written
from procura.llm.textcode import column_chunks, mix64, shingles, word_hashes

ROWS_PER_BAND = 5
MISS = 1e-7
_SCATTER = np.uint64(0xA0761D6478BD642F)
_BLOCK = 2048
_PAIRS = 512


def bands_for(similarity: float, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    """Fewest bands with which a pair at the threshold shares none with probability `miss` at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(similarity, 1 - 1e-9) ** rows)))


def signature(codes: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of one non-empty set of 64-bit codes."""
    scattered = (mix64(codes ^ _SCATTER) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(scattered), _BLOCK):
        x = scattered[None, at : at + _BLOCK] - shift
        t = x >> np.uint32(16)
        x ^= t
        x *= np.uint32(0x85EBCA6B)
        np.right_shift(x, np.uint32(13), out=t)
        x ^= t
        x *= np.uint32(0xC2B2AE35)
        np.right_shift(x, np.uint32(16), out=t)
        x ^= t
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_codes(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit code for each band; bands never share a code space."""
    groups = sig.reshape(-1, rows).astype(np.uint64)
    h = np.arange(1, len(groups) + 1, dtype=np.uint64)
    for k in range(rows):
        h = mix64(h * _SCATTER + groups[:, k])
    return h.view(np.int64)


def _set_key(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, encoded in column_chunks(batch.column("text")):
                hashes, at = word_hashes(encoded, lower=True)
                sizes, keys, codes = [], [], []
                for i in range(len(encoded)):
                    own = shingles(hashes[at[i] : at[i + 1]], words)
                    sizes.append(len(own))
                    keys.append(_set_key(own) if len(own) else None)
                    if len(own):
                        codes.append(band_codes(signature(own, bands * rows), rows))
                has = np.array([k is not None for k in keys])
                ends = np.concatenate(([0], np.cumsum(has) * bands)).astype(np.int32)
                flat = pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int64))
                own = [batch.column(c).slice(first, end - first) for c in ("doc_id", "text_code")]
                new = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)]
                yield pa.RecordBatch.from_arrays(own + new, names=["doc_id", "text_code", "n_shingles", "set_key", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, wanted = batch.column("node"), batch.column("set_key")
            for first, end, encoded in column_chunks(batch.column("text")):
                hashes, at = word_hashes(encoded, lower=True)
                own = [shingles(hashes[at[i] : at[i + 1]], words) for i in range(end - first)]
                right = [len(o) > 0 and _set_key(o) == w.as_py() for o, w in zip(own, wanted.slice(first, end - first), strict=True)]
                codes = pa.array([o.tobytes() if r else None for o, r in zip(own, right, strict=True)], pa.binary())
                found = pa.RecordBatch.from_arrays([nodes.slice(first, end - first), codes], names=["node", "codes"])
                yield found.filter(pa.array(right, pa.bool_()))

    return run


def _codes(value: pa.BinaryScalar) -> np.ndarray:
    """The set behind an Arrow value, without a copy."""
    return np.frombuffer(value.as_buffer(), np.uint64)


def _compare(similarity: float, differences: bool):
    """Sizes, intersection and, where asked for, symmetric difference of the sets of each pair."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PAIRS):
                part = batch.slice(at, _PAIRS)
                n_a, n_b, shared, diffs = [], [], [], []
                for left, right in zip(part.column("codes_a"), part.column("codes_b"), strict=True):
                    x, y = _codes(left), _codes(right)
                    diff = np.setxor1d(x, y, assume_unique=True)
                    n_a.append(len(x))
                    n_b.append(len(y))
                    shared.append((len(x) + len(y) - len(diff)) // 2)
                    diffs.append(diff.view(np.int64) if differences else None)
                a, b, both = (np.array(n, dtype=np.int64) for n in (n_a, n_b, shared))
                linked = 100 * both >= percent * (a + b - both)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), *map(pa.array, (a, b, both, linked)), pa.array(diffs, pa.list_(pa.int64()))],
                    names=["a", "b", "n_a", "n_b", "shared", "linked", "diff"],
                )

    return run


def near_duplicates(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, rows: int = ROWS_PER_BAND, bands: int | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text).

    `similarity` counts in whole percent. `kept` marks the row whose doc_id is its component's.
    """
    bands = bands or bands_for(similarity, rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_code"))
    signed = written(
        texts.mapInArrow(
            _sign(words, bands, rows), "doc_id long, text_code long, n_shingles long, set_key binary, bands array<long>"
        )
    )
    distinct = signed.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"),
        F.first(F.struct("doc_id", "text_code")).alias("row"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    )
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()))

    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    members = written(members.join(shared, "bucket"))

    wanted = members.select("node").distinct().join(nodes.select("node", "row", "set_key"), "node")
    # by id and text, so that rows without an id or with the same one meet their own node only
    same = F.col("t.doc_id").eqNullSafe(F.col("w.row.doc_id")) & (F.col("t.text_code") == F.col("w.row.text_code"))
    found = texts.alias("t").join(wanted.alias("w"), same)
    sets = written(
        found.select("node", "set_key", "text").mapInArrow(_sets(words), "node long, codes binary").dropDuplicates(["node"])
    )
    labels = _link(members, sets, similarity)

    of_node = nodes.select("node", "doc_id", "set_key").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    # written, so that the join below reads plain shuffles and a large component's rows can be split
    roots = written(of_node.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    by_key = of_node.join(roots, "label").select("set_key", "component_id")
    return (
        signed.drop("bands", "text_code")
        .join(by_key, "set_key", "left")
        .withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` with one of each component: smallest doc_id, nulls last. Same columns.

    Rows are numbered first, so null and repeated ids neither lose nor merge different texts.
    Rows without words stay, each on its own.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), **how)
    ids = numbered.select(row, F.col("doc_id").alias("id"))
    members = found.select(F.col("doc_id").alias(row), F.col("component_id").alias("component")).join(ids, row)
    first = F.struct(F.col("id").isNull(), F.col("id"), F.col(row))
    chosen = members.groupBy("component").agg(F.min_by(row, first).alias(row)).select(row)
    return numbered.join(chosen, row, "left_semi").select(*docs.columns)


def _link(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, label): equal labels for nodes that verified links connect; nodes without a bucket are missing."""
    nothing = F.col("node").alias("label"), F.lit(0).alias("links")
    labels = written(members.select("node").distinct().select("node", *nothing))

    # every member against its bucket's smallest node
    active = members.join(labels, "node")
    pivots = active.groupBy("bucket").agg(F.min(F.struct("node", "label")).alias("p")).select("bucket", "p.*")
    members, labels = _star(active, pivots, sets, labels, similarity)

    # what lies outside the largest part of its bucket against the best linked of those
    active = written(_unsettled(members.join(labels, "node")))
    parts = active.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("largest"))
    outside = active.join(largest, "bucket").where("label <> largest.label")
    pivots = outside.groupBy("bucket").agg(F.max_by(F.struct("node", "label"), F.struct("links", "node")).alias("p"))
    members, labels = _star(active, pivots.select("bucket", "p.*"), sets, labels, similarity)

    # every member of a bucket still in several parts against the best linked node of its largest component
    # written, so that the join reads plain shuffles and a large component's rows can be split
    hubs = written(
        labels.groupBy("label").agg(
            F.count(F.lit(1)).alias("size"), F.max_by("node", F.struct("links", -F.col("node"))).alias("hub")
        )
    )
    active = _unsettled(members.join(labels, "node")).join(hubs, "label")
    pivots = active.groupBy("bucket").agg(F.max(F.struct("size", -F.col("n"), "hub")).alias("p")).select("bucket", "p.hub")
    pairs = active.join(pivots.withColumnRenamed("hub", "a"), "bucket").select("a", F.col("node").alias("b")).distinct()
    group = _compared(pairs, sets, similarity, differences=True)
    labels = _contract(labels, group.where("linked and a <> b"))
    close = _close(group.join(labels.select(F.col("node").alias("b"), "label"), "b"), similarity)
    return _contract(labels, _compared(close, sets, similarity).where("linked"))


def _unsettled(active: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one label."""
    parted = active.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return active.join(parted.select("bucket"), "bucket")


def _star(active: DataFrame, pivots: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float):
    """Compare each member with its bucket's pivots (bucket, node, label) of other labels; pivots then leave the buckets."""
    percent = round(similarity * 100)
    pivots = written(pivots)
    p = pivots.join(active.select("bucket", "node", F.col("n").alias("p_n")), ["bucket", "node"])
    p = p.select("bucket", F.col("node").alias("pivot"), F.col("label").alias("p_label"), "p_n")
    pairs = active.join(p, "bucket").where("label <> p_label").where(f"100 * least(n, p_n) >= {percent} * greatest(n, p_n)")
    pairs = pairs.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    labels = _contract(labels, _compared(pairs, sets, similarity).where("linked"))
    return active.join(pivots, ["bucket", "node"], "left_anti").select("bucket", "node", "n"), labels


def _close(group: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members of one pivot, with different labels, that could still link.

    With m codes of the pivot missing in a member and r codes added, let e be
    (1 - share) * m + share * r for share = similarity / (1 + similarity). Two members link
    only if their differences from the pivot have at least e1 + e2 - (1 - 2 * share) * size
    codes in common, size being the pivot's. One of the two is not linked with the pivot,
    so that number is positive, and a prefix filter with positions finds the pairs: in an
    order by rarity the first common code must leave room for the others.
    """
    share = similarity / (1 + similarity)
    e = (1 - share) * (F.col("n_a") - F.col("shared")) + share * (F.col("n_b") - F.col("shared"))
    room = (1 - 2 * share) * F.col("n_a")
    member = group.where("a <> b").select(
        "a", "b", "label", "linked", "diff", F.size("diff").alias("d"), (e - 1e-9).alias("e"), room.alias("room")
    )
    codes = member.select("a", "b", F.explode("diff").alias("code"))
    rarity = codes.groupBy("a", "code").agg(F.count(F.lit(1)).alias("uses"))
    order = codes.join(rarity, ["a", "code"]).groupBy("a", "b").agg(
        F.array_sort(F.collect_list(F.struct("uses", "code"))).alias("order")
    )
    needed = F.greatest(F.lit(1), F.ceil(F.when(F.col("linked"), F.col("e")).otherwise(F.col("e") - F.col("room"))))
    entries = (
        member.drop("diff")
        .join(order, ["a", "b"])
        .select("a", "b", "label", "linked", "e", "room", "d", needed.alias("needed"), F.posexplode("order").alias("at", "code"))
        .where("at <= d - needed and code.uses > 1")
        .select("a", F.col("code.code").alias("code"), "b", "label", "linked", "e", "room", (F.col("d") - F.col("at")).alias("left"))
    )
    entries = written(entries)
    other = entries.select("a", "code", *(F.col(c).alias(f"o_{c}") for c in ("b", "label", "linked", "e", "left")))
    pairs = entries.where("not linked").join(other, ["a", "code"]).where(
        "label <> o_label and (o_linked or b < o_b) and least(left, o_left) >= e + o_e - room"
    )
    return pairs.select(F.least("b", "o_b").alias("a"), F.greatest("b", "o_b").alias("b")).distinct()


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float, differences: bool = False) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("codes").alias("codes_a"))
    right = sets.select(F.col("node").alias("b"), F.col("codes").alias("codes_b"))
    return written(
        pairs.join(right, "b").join(left, "a").mapInArrow(
            _compare(similarity, differences), "a long, b long, n_a long, n_b long, shared long, linked boolean, diff array<long>"
        )
    )


def _contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after `links` (a, b) joined more nodes; `links` counts a node's verified links."""
    ends = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.groupBy("a").agg(F.count(F.lit(1)).alias("more"))
    label = labels.select("node", "label")
    between = links.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b")
    roots = components(between.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    return written(
        labels.join(degree.withColumnRenamed("a", "node"), "node", "left")
        .join(roots.withColumnRenamed("node", "label"), "label", "left")
        .select(
            "node",
            F.coalesce("root", "label").alias("label"),
            (F.col("links") + F.coalesce("more", F.lit(0))).cast("int").alias("links"),
        )
    )
