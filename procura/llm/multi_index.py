"""Nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut into two halves, each half has its own codebook, and a cell is a pair
of codewords. For a query, a heap walks the pairs in the order of their summed distances
(the multi-sequence algorithm) until the cells passed hold a given share of all vectors;
the entries of those cells are reranked by exact cosine in double precision.

Codebooks are fitted by k-means on at most `sample` vectors, those with the smallest id
hashes; every vector is indexed. Equal vectors are one index entry with its `k + 1` smallest
ids, which is all that ties can ever need, so a vector that a third of all rows repeat is
no hot cell. Entries are dealt into groups of neighbouring cells, as many as fit in a task's
memory; the queries pass by every group with the cells they visit, and a task keeps only the
k best of its group for each. The sample is picked by executors and is all that the driver holds.

Defined cases: vectors that are null, zero, of another dimension than most, or hold null or
non-finite components take no part, neither as query nor as candidate; a null id neither.
Fewer than k candidates give fewer ranks. An empty table gives no rows. Repeated rows with
one id and one vector count once. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procura.llm.common import written

CODEWORDS = 32
SAMPLE = 20_000
SHARE = 0.6
#: leading bits of an id's hash by which rows are counted before the sample is picked
RANGE_BITS = 12
#: bytes of vectors a group holds, queries that pass by at once, entries scored at once, candidates kept before they are ranked
GROUP_BYTES = 64 << 20
QUERIES = 1024
BLOCK = 2048
WAITING = 1 << 18
TOLERANCE = 1e-12


def fit_codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means codewords; starts from points spread over the sample."""
    size = min(size, len(points))
    words = points[np.linspace(0, len(points) - 1, size).astype(int)].copy()
    for _ in range(rounds):
        near = nearest_word(points, words)
        for j in range(size):
            own = points[near == j]
            if len(own):
                words[j] = own.mean(axis=0)
    return words


def _distances(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ words.T + (words**2).sum(1)[None, :]


def nearest_word(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _distances(points, words).argmin(axis=1)


def cells_by_distance(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) in ascending order of first[i] + second[j]."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]


def _halves(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = unit.shape[1] // 2
    return unit[:, :cut], unit[:, cut:]


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id long, vector array<double>) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    good = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null").where(good)
    widths = out.groupBy(F.size("vector").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    width = widths.agg(F.max(F.struct("n", "w")).alias("m")).first()["m"]
    return out.where(F.size("vector") == (width["w"] if width else 0))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one width, a row each."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def sampled(base: DataFrame, sample: int) -> np.ndarray:
    """Vectors of the `sample` rows with the smallest id hashes, a row each.

    Hashes are counted by their leading bits first, so only the lowest ranges are looked at
    again, and executors pick the rows: a limit that is collected sends the driver as many
    rows of every task.
    """
    keyed = base.select("vector", F.xxhash64("vec_id").alias("h")).withColumn("range", F.shiftright("h", 64 - RANGE_BITS))
    held = {r["range"]: r["n"] for r in keyed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 ** RANGE_BITS
    edge, before = None, 0
    for edge in sorted(held):
        before += held[edge]
        if before >= sample:
            break
    if edge is None:
        return np.empty((0, 0))
    low = keyed.where(F.col("range") <= edge).orderBy("h").limit(sample)
    return _matrix(written(low.select("vector")).toArrow().column("vector").combine_chunks())


class _Group:
    """Entries of neighbouring cells, and the k best of them for queries that pass by."""

    def __init__(self, cells: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int):
        self.vectors, self.ids, self.k = vectors, ids, k
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        cuts = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
        self.blocks = [
            (int(cells[a]), x, min(x + BLOCK, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in range(a, b, BLOCK)
        ]

    def best(self, queries: np.ndarray, query_ids: list[int], visits: np.ndarray) -> list[list[tuple[float, int]]]:
        """For each query its k best (-score, id) among the cells it visits."""
        unit, top = _unit(queries), self.k + 1
        # best scores so far; one entry may hold the query alone, so k + 1 entries hold k others
        tops = np.full((len(queries), top), -np.inf)
        kept: list[list[tuple[float, int]]] = [[] for _ in query_ids]
        found, waiting = [], 0

        def settle() -> None:
            q, e, s = (np.concatenate(x) for x in zip(*found, strict=True))
            good = np.flatnonzero(s >= tops.min(axis=1)[q] - TOLERANCE)
            good = good[np.argsort(q[good], kind="stable")]
            q, e = q[good], e[good]
            cuts = np.flatnonzero(np.diff(q, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                n = int(q[a])
                own, mine = queries[n], set(kept[n])
                for at in e[a:b]:
                    v = self.vectors[at]
                    exact = float(own @ v / (np.sqrt(own @ own) * np.sqrt(v @ v)))
                    mine.update((-exact, i) for i in self.ids[at] if i != query_ids[n])
                kept[n] = heapq.nsmallest(self.k, mine)

        for cell, a, b in self.blocks:
            asked = np.flatnonzero(visits[:, cell])
            if not len(asked):
                continue
            score = unit[asked] @ self.vectors[a:b].T / self.norms[a:b]
            # the best of every strip stands for it, which is cheaper and never too high
            strip = (b - a) // (4 * top)
            some = score if strip < 2 else np.maximum.reduceat(score, np.arange(0, b - a, strip), axis=1)
            both = np.concatenate([tops[asked], some], axis=1)
            tops[asked] = np.partition(both, both.shape[1] - top, axis=1)[:, both.shape[1] - top :]
            q, e = np.nonzero(score >= tops[asked].min(axis=1)[:, None] - TOLERANCE)
            found.append((asked[q], e + a, score[q, e]))
            waiting += len(q)
            if waiting > WAITING:
                settle()
                found, waiting = [], 0
        if found:
            settle()
        return kept


def _reranked(k: int, cells: int):
    """Rows (group, cell, vector, ids, visits), a group's entries by cell and then its queries, in cell `cells`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, group = None, [], None
        for batch in batches:
            groups, cell = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("group", "cell"))
            asks = cell == cells
            cuts = np.flatnonzero((np.diff(groups, prepend=-1) != 0) | np.diff(asks, prepend=~asks[:1]))
            for a, b in zip(cuts, [*cuts[1:], len(groups)], strict=True):
                if groups[a] != number:
                    number, parts, group = groups[a], [], None
                rows = batch.slice(a, b - a)
                if not asks[a]:
                    parts.append((cell[a:b], _matrix(rows.column("vector")), rows.column("ids").to_pylist()))
                    continue
                if group is None and parts:
                    held, vectors, ids = zip(*parts, strict=True)
                    group = _Group(np.concatenate(held), np.concatenate(vectors), [x for part in ids for x in part], k)
                    parts = []
                if group is not None:
                    for first in range(0, len(rows), QUERIES):
                        yield answers(rows.slice(first, QUERIES), group)

    def answers(rows: pa.RecordBatch, group: _Group) -> pa.RecordBatch:
        query_ids = [x[0] for x in rows.column("ids").to_pylist()]
        visits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=cells) for x in rows.column("visits").to_pylist()])
        kept = group.best(_matrix(rows.column("vector")), query_ids, visits)
        out = [(query, vec, -s) for query, found in zip(query_ids, kept, strict=True) for s, vec in found]
        query, vec, score = zip(*out, strict=True) if out else ((), (), ())
        names = ["query_id", "vec_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=names)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, codewords: int = CODEWORDS, sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k nearest other rows of `rows`."""
    spark = rows.sparkSession
    base = written(usable(rows))
    asked = usable(queries).dropDuplicates(["vec_id", "vector"])
    empty = "query_id long, rank int, vec_id long, score double"
    picked = sampled(base, sample)
    if not len(picked):
        return spark.createDataFrame([], empty)
    points = _halves(_unit(picked))
    books = tuple(fit_codebook(p, codewords) for p in points)
    held = spark.sparkContext.broadcast(books)
    cells = codewords**2

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                halves = _halves(_unit(np.stack(batch["vector"].to_numpy())))
                i, j = (nearest_word(h, w) for h, w in zip(halves, held.value, strict=True))
                yield batch.assign(cell=i * codewords + j)

    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    few = base.distinct().withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    groups = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = written(groups.mapInPandas(cell, "vector array<double>, ids array<long>, cell int"))
    sizes = {r["cell"]: r["n"] for r in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `cells` rows
    total = sum(sizes.values())
    wanted = max(k + 1, int(np.ceil(share * total)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            halves = _halves(_unit(np.stack(batch["vector"].to_numpy())))
            first, second = (_distances(h, w) for h, w in zip(halves, held.value, strict=True))
            visits = np.zeros((len(batch), cells), bool)
            for q in range(len(batch)):
                passed = 0
                for i, j in cells_by_distance(first[q], second[q]):
                    here = sizes.get(i * codewords + j, 0)
                    if here:
                        visits[q, i * codewords + j] = True
                        passed += here
                    if passed >= wanted:
                        break
            ids = [np.array([x]) for x in batch["vec_id"]]
            yield pd.DataFrame({"vector": batch["vector"], "ids": ids, "visits": [x.tobytes() for x in np.packbits(visits, axis=1)]})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    visits = asked.repartition(tasks).mapInPandas(walk, "vector array<double>, ids array<long>, visits binary")
    # each group once over the cores at least, and small enough for a task
    room = max(1, GROUP_BYTES // (8 * picked.shape[1]))
    parts = min(total, max(2 * spark.sparkContext.defaultParallelism, -(-total // room)))
    places = np.cumsum([0, *sizes.values()]).tolist()
    numbered = spark.createDataFrame([(c, n, x) for (c, n), x in zip(sizes.items(), places, strict=False)], "cell int, n long, before long")
    place = F.col("before") + F.pmod(F.xxhash64("vector"), F.col("n"))
    dealt = entries.join(F.broadcast(numbered), "cell").select(  # at most `cells` rows
        F.floor(place * parts / total).cast("int").alias("group"), "cell", "vector", "ids", F.lit(None).cast("binary").alias("visits")
    )
    passing = visits.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("group"), F.lit(cells).alias("cell"), "vector", "ids", "visits")
    both = dealt.unionByName(passing).repartitionById(parts, "group").sortWithinPartitions("group", "cell")
    found = both.mapInArrow(_reranked(k, cells), "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
