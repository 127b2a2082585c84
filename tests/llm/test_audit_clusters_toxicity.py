"""Filter audit, centroid clusters and toxicity against plain Python on small fixtures."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from procura.llm import centroids, filter_audit, toxicity

SCHEMA = "doc_id long, text string, source string, lang string, part string, failed string, score string, toxic string"


def _documents():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "one two", "A B C", "a" * 50 + "B", "x $ y", "é" * 60 + "A", "  wide blanks"]
    for n in (199, 200, 201, 400):
        texts += [" ".join(rng.choices(vocab, k=n)), " ".join(rng.choices(vocab[:80], k=n)), " ".join(rng.choices(vocab, k=n)) + " | ABCDEFGH" * 9]
    texts += ["w " * 100_000, "same text again"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["a", "b", None, "", "hot", "hot", "hot"])) for _ in range(160)]
    rows += [(90 + i, "same text again", "hot") for i in range(40)] + [(None, "same text again", "hot"), (90, "same text again", "hot"), (90, "same text again", "hot")]
    return [(*r, "en", "clash", "clash", "clash", "clash") for r in rows]


def _audit(rows, labels):
    first = {}
    for d, text, *_ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    judged = []
    for d, text, part, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": d is not None and d > first[text],
        }
        own = [x for x in labels if d is not None and x[0] == d]
        judged.append((part or "", {f for f in failed if failed[f]}, any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own)))
    out, taken = {}, {}
    for order in itertools.permutations("ABCDE"):
        for step, f in enumerate(order, 1):
            before = set(order[: step - 1])
            for part in {j[0] for j in judged}:
                here = [j for j in judged if j[0] == part]
                removed = [j for j in here if f in j[1] and not j[1] & before]
                out[part, "".join(order), step] = (
                    sum(not j[1] & (before | {f}) for j in here),
                    len(removed),
                    sum(f in j[1] and bool(j[1] & before) for j in here),
                    sum(j[1] == {f} for j in here),
                    sum(j[2] for j in removed),
                    sum(j[3] for j in removed),
                )
                taken[part, f] = taken.get((part, f), 0) + len(removed)
    return {k: (*v, taken[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rows = _documents()
    labels = [(i, i % 3 % 2, None if i % 5 else 1) for i in range(0, 120, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, marks).collect()}
    assert got == _audit(rows, labels) and len(got) == 4 * 600
    assert {k: (*v[:4], v[6]) for k, v in _audit(rows, []).items()} == {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley)
        for r in filter_audit.audit(docs, marks.limit(0)).collect()
    }
    assert filter_audit.audit(docs.limit(0), marks).count() == 0


def test_fewer_filters(spark):
    rows = spark.createDataFrame([("p", m, 3) for m in (0, 1, 2, 3, 3)], "part string, failed int, label int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.good_lost, r.shapley) for r in filter_audit.orders_report(filter_audit.subset_survivors(rows, 2), "XY").collect()}
    assert got == {("XY", 1): (2, 3, 3, 4), ("XY", 2): (1, 1, 1, 4), ("YX", 1): (2, 3, 3, 4), ("YX", 2): (1, 1, 1, 4)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 26, 27, 1000, 4099])
def test_positional_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert filter_audit.positional_counts(words).tolist() == [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]


def test_survival_words():
    table = filter_audit.survival_words(5)
    assert all((int(table[m]) >> s & 1) == (m & s == 0) for m in range(32) for s in range(32))


def _lloyd(rows, k, rounds):
    """Rows (vec_id, ints); a null id starts a centroid only at the end."""
    start = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [list(r[1]) for r in start[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((apart(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for j in range(len(cents)):
            held = [v for (_, v), o in zip(rows, own, strict=True) if o == j]
            if held:
                cents[j] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    found = [nearest(v) for _, v in rows]
    inertia = {j: sum(d for d, o in found if o == j) for j in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i is None, i), j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(rows, found, strict=True))


def _clustered(frame, **how):
    return sorted(((r.vec_id is None, r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clusters(frame, **how).collect())


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (5, 6), (1, 2)])
def test_clusters(spark, k, rounds):
    rng = np.random.default_rng(k)
    centres = rng.normal(0, 4, (6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(0, 0.4, 8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)] + [(7, [-1.0] * 8), (7, [1.0] * 8), (None, [0.25] * 8), (2000, [1e6] * 8)]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 7), (3003, [0.0] * 7 + [None]), (3004, [0.0] * 7 + [float("nan")]), (3005, [float("inf")] + [0.0] * 7), (3006, [1e30] * 8)]
    frame = spark.createDataFrame([(i, v, "x", 9) for i, v in rows + odd], "vec_id long, embedding array<float>, cluster string, distance int")
    ints = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows]
    got = _clustered(frame, k=k, dimension=8, rounds=rounds)
    want = _lloyd(ints, k, rounds)
    key = lambda r: repr(r)  # noqa: E731  # null ids do not compare
    assert sorted(got, key=key) == sorted(want, key=key)


def test_few_scans_once_centroids_settle(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 4, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.3, 8)).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    state, _ = centroids.cluster(frame, 6, 8, 6)
    assert state.where("scanned").count() < 120


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (1, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = _clustered(frame, k=16, dimension=2, rounds=2)
    assert got == _lloyd([(1, [0, 0]), (2, [64, 0]), (1, [0, 0])], 16, 2)
    assert _clustered(frame.limit(0), k=16, dimension=2, rounds=2) == []
    assert _clustered(frame, k=3, dimension=5, rounds=2) == []


def test_bounds_fall_far_enough_and_less_than_the_drift():
    rng = np.random.default_rng(4)
    less = total = 0
    for _ in range(300):
        old = rng.normal(0, 5, (4, 3))
        new = old + rng.normal(0, rng.choice([0.01, 0.5, 3]), (4, 3))
        radius = np.abs(rng.normal(0, 2, 4))
        moved, fall = centroids.drifts(old, new, radius)
        for i in range(4):
            ray = rng.normal(size=(200, 3))
            x = old[i] + radius[i] * ray / np.sqrt((ray**2).sum(axis=1))[:, None] * rng.choice([1.0, 0.7], (200, 1))
            for j in set(range(4)) - {i}:
                gone = np.sqrt(((x - old[j]) ** 2).sum(axis=1)) - np.sqrt(((x - new[j]) ** 2).sum(axis=1))
                assert gone.max() <= fall[i]
            most = max(moved[j] for j in range(4) if j != i)
            assert fall[i] <= most * (1 + 1e-8) + 1e-8
            less, total = less + fall[i], total + most
    assert less < 0.8 * total


INSULT = ("zork", "blarg", "fnord")


def _labelled(n=400):
    rng = random.Random(8)
    vocab = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        said = [" ".join(rng.choices(vocab, k=6)) for _ in range(rng.randrange(1, 9))]
        bad = i % 5 == 2
        if bad:
            at = rng.randrange(len(said))
            said[at] = f"{said[at]} {rng.choice(INSULT)} {rng.choice(vocab)}"
        rows.append((i, "$ " + ". ".join(said) + "!", i))
        labels.append((i, int(bad), "clash"))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = _labelled()
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t, _ in rows], "doc_id long, text string, score string, toxic string, sentences string")
    marks = spark.createDataFrame([*labels, (0, None, "x"), (None, 1, "x"), (2, 0, "x")], "doc_id long, toxic int, text string")
    return rows, docs, marks


def test_toxicity_is_learned_and_located(spark, learned):
    rows, docs, marks = learned
    out = {r.doc_id: r for r in toxicity.predictions(docs, marks).collect()}
    assert len(out) == len(rows)
    for i, text, _ in rows:
        bad = i % 5 == 2
        assert out[i].predicted == bad and out[i].n_toxic_sentences == bad and 0 <= out[i].score <= 1
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    model = toxicity.fit(docs, marks)
    assert set(model.number) == set(INSULT)
    odd = [(1, "Good words. You ZORK, é! Fine."), (2, None), (3, ""), (4, "clean. " * 30000), (5, "azorka blarg1x"), (None, "blarg. " * 50)]
    frame = spark.createDataFrame([(i, t, "kept", 5) for i, t in odd] * 2, "doc_id long, text string, score string, other int")
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert toxicity.score(frame, model).count() == 12 and [f for f in toxicity.score(frame, model).columns] == ["doc_id", "text", "other", "score", "sentences"]
    (hit,) = got[1].sentences
    assert odd[0][1][hit.start : hit.end].strip() == "You ZORK, é" and hit.score > 0.5 < got[1].score
    assert got[2].score == got[3].score == got[4].score < 0.2 and got[None].score > 0.99 and len(got[None].sentences) == 50
    assert got[5].score > 0.5  # digits part words


def test_nothing_to_learn_toxicity_from(spark, learned):
    _, docs, marks = learned
    for known in (marks.limit(0), marks.where("toxic is null")):
        assert {(r.score, r.predicted) for r in toxicity.predictions(docs, known).collect()} == {(0.0, 0)}
    assert {r.predicted for r in toxicity.predictions(docs, marks.withColumn("toxic", F.lit(0))).collect()} == {0}
    assert {r.predicted for r in toxicity.predictions(docs, marks.withColumn("toxic", F.lit(1))).collect()} == {1}
    assert toxicity.predictions(docs.limit(0), marks).count() == 0


def test_slopes_are_those_of_the_loss():
    bags = pd.DataFrame({"toxic": [True, False, True, False], "sentences": [[[0], [0, 1]], [[1]], [], [[0], [0], [2]]], "n": [1, 2, 1, 3]})
    weights = np.array([0.4, -0.3, 1.0, -0.5, -2.0])
    at = lambda w: next(iter(toxicity._slopes(w)(iter([bags])))).iloc[0]
    slope = at(weights).slope
    for j in range(5):
        step = np.zeros(5)
        step[j] = 1e-5
        assert math.isclose(slope[j], (at(weights + step).loss - at(weights - step).loss) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)
