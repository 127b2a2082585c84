"""Mixing domains to target weights with soft memberships, in DataFrame functions only.

A naive Bayes classifier fitted on the labelled table gives each document posteriors of the
domains high, low and toxic. Document rates start at 1 and follow projected gradient steps
on the weighted least squares distance between expected domain tokens,
sum of rate * tokens * posterior, and their targets; negative rates are set to 0. The
gradient is taken in the metric of the domains' shared token mass in documents still in use,
so few steps do; where that does not lessen the distance, the plain gradient is used. Steps
end at a distance of CLOSE, when they gain little, or after STEPS of them. Each step sends one number per pair of domains to the
driver; rates are column expressions over one written table of posteriors.

The classifier is fitted on at most `fit_docs` labelled documents, those with the smallest
id hashes; everything else covers all rows. A feature counts only where it is significant.
Words do not come independently, so the summed log odds say too much: a quarter of these
documents is kept back, and a scale and a bias of the log odds are fitted to it (Platt), so
that posteriors are as frequent as the labels say.

Defined cases: null or empty text has no tokens; its rate is fitted like others' but moves
no total. With no labelled rows all posteriors come from the prior alone. Null labels count
as 0; of repeated labels of a document the largest counts. Repeated rows keep rates of
their own. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.llm.common import masked, unmasked, written

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.8, "low": 0.2, "toxic": 0.0}
HEADROOM = 1.1
FIT_DOCS = 4000
BUCKETS = 1 << 14
SIGNIFICANT = 4.0
STEPS = 25
NEWTON = 8
RIDGE = 1e-3
SLOW = 1e-4
CLOSE = 1e-4


def _words(text: Column) -> Column:
    plain = F.split(F.translate(F.coalesce(text, F.lit("")), "\n\t\r", "   "), " ")
    return F.filter(plain, lambda w: w != "")


def _features(words: Column, distinct: Column) -> Column:
    """Bucket numbers of words, of their last two letters, and of two shapes of the text."""
    whole = F.transform(distinct, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    ends = F.transform(distinct, lambda w: F.pmod(F.xxhash64(F.right(w, F.lit(2)), F.lit(1)), F.lit(BUCKETS)).cast("int"))
    fresh = F.floor(10 * F.size(distinct) / F.greatest(F.lit(1), F.size(words))).cast("int")
    length = F.least(F.lit(12), F.floor(F.log2(1 + F.size(words)))).cast("int")
    return F.array_distinct(F.concat(whole, ends, F.array(BUCKETS + fresh, BUCKETS + 11 + length)))


def _prepared(docs: DataFrame) -> DataFrame:
    words = docs.withColumn("_words", _words(F.col("text"))).withColumn("_distinct", F.array_distinct("_words"))
    return words.withColumn("_tokens", F.size("_words").cast("long")).withColumn("_features", _features(F.col("_words"), F.col("_distinct")))


def _fit(docs: DataFrame, labels: DataFrame, fit_docs: int) -> dict[str, tuple[float, float, list[float]]]:
    """Bias, scale and feature weights (log odds) for good quality and for toxicity."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce("quality", F.lit(0))).alias("_quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("_toxic")
    )
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = _prepared(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most fit_docs rows
    kept_back = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    every = written(rows.select("_features", "_quality", "_toxic", kept_back.alias("_kept_back")))
    rows = every.where("not _kept_back")
    total = rows.agg(F.count(F.lit(1)), F.sum("_quality"), F.sum("_toxic")).first()
    n, ones = total[0], {"quality": total[1] or 0, "toxic": total[2] or 0}
    counts = (
        rows.select(F.explode("_features").alias("f"), "_quality", "_toxic")
        .groupBy("f")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_quality").alias("quality"), F.sum("_toxic").alias("toxic"))
        .collect()  # at most 2 ** 14 + 24 rows
    )
    held = {}
    for name, pos in ones.items():
        neg = n - pos
        weights = [0.0] * (BUCKETS + 24)
        for r in counts:
            a, b = r[name], r["n"] - r[name]
            weight = math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))
            spread = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if abs(weight) > SIGNIFICANT * spread:
                weights[r["f"]] = round(weight, 4)
        held[name] = weights
    fitted = _calibrated(every.where("_kept_back"), held)
    return {name: (*fitted[name], weights) for name, weights in held.items()}


def _calibrated(rows: DataFrame, held: dict[str, list[float]]) -> dict[str, tuple[float, float]]:
    """Bias and scale of each label's log odds by Newton steps on rows kept back; two labels, six sums a step."""
    odds = written(rows.select(*(_odds(w).alias(name) for name, w in held.items()), *(f"_{name}" for name in held)))
    found = {name: np.array([0.0, 0.1]) for name in held}
    for _ in range(NEWTON):
        sums = []
        for name, (bias, scale) in found.items():
            x, p = F.col(name), _sigmoid(F.lit(float(bias)) + float(scale) * F.col(name))
            off, w = p - F.col(f"_{name}"), p * (1 - p)
            sums += [F.sum(v).alias(f"{name}{i}") for i, v in enumerate((off, off * x, w, w * x, w * x * x))]
        total = odds.agg(*sums).first()
        for name in found:
            s = [total[f"{name}{i}"] or 0.0 for i in range(5)]
            pull = np.array([0.0, 1.0]) * (found[name] - (0.0, 0.1)) + np.array([1e-3, 0]) * found[name]
            curve = np.array([[s[2] + 1e-3, s[3]], [s[3], s[4] + 1.0]])
            found[name] = found[name] - np.linalg.solve(curve, np.array(s[:2]) + pull).clip(-2, 2)
    return {name: (float(b), float(a)) for name, (b, a) in found.items()}


def _odds(weights: list[float]) -> Column:
    held = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    return F.aggregate("_features", F.lit(0.0), lambda s, f: s + F.get(held, f))


def _sigmoid(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))


def _chance(bias: float, scale: float, weights: list[float]) -> Column:
    return _sigmoid(bias + scale * _odds(weights))


def posteriors(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """`docs` with tokens, p_high, p_low and p_toxic; input columns of these names are replaced."""
    model = _fit(docs, labels, fit_docs)
    new = {"tokens", *(f"p_{d}" for d in DOMAINS)}
    kept = [c for c in docs.columns if c not in new]
    scored = _prepared(docs).withColumns({"_q": _chance(*model["quality"]), "_t": _chance(*model["toxic"])})
    return scored.select(
        *kept,
        F.col("_tokens").alias("tokens"),
        ((1 - F.col("_t")) * F.col("_q")).alias("p_high"),
        ((1 - F.col("_t")) * (1 - F.col("_q"))).alias("p_low"),
        F.col("_t").alias("p_toxic"),
    )


def fit_rates(scored: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> Column:
    """The fitted rate as an expression over (tokens, p_<domain>); `scored` should be stored.

    Without a budget, the tokens asked for give the first domain HEADROOM of what it has.
    """
    targets = targets or TARGETS
    names = list(targets)
    mass = scored.agg(*(F.sum(F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in names)).first()
    mass = {d: mass[d] or 0.0 for d in names}
    share = sum(targets.values())
    if budget is None:
        lead = names[0]
        budget = HEADROOM * mass[lead] * share / targets[lead] if targets[lead] else sum(mass.values())
    goal = {d: budget * targets[d] / share for d in names}
    used = [d for d in names if mass[d] > 0]

    def measure(rate: Column) -> tuple[float, np.ndarray, np.ndarray]:
        """Weighted distance, residuals, and the token mass that domains share in documents in use."""
        weight = F.col("tokens").cast("double")
        have = [F.sum(F.col("r") * weight * F.col(f"p_{d}")) for d in used]
        both = [F.sum(F.when(F.col("r") > 0, weight * F.col(f"p_{a}") * F.col(f"p_{b}"))) for a in used for b in used]
        found = [x or 0.0 for x in scored.select(rate.alias("r"), "*").agg(*have, *both).first()]
        off = np.array([x - goal[d] for x, d in zip(found, used)])
        metric = np.array(found[len(used) :]).reshape(len(used), len(used))
        return float((off**2 / np.array([mass[d] for d in used])).sum()), off, metric

    rate = F.lit(1.0)
    if not used:
        return rate
    distance, off, metric = measure(rate)
    scale = np.array([mass[d] for d in used])
    for _ in range(STEPS):
        if distance <= CLOSE**2 * max(budget, 1.0):
            break
        ridge = RIDGE * np.trace(metric) * np.eye(len(used))
        for step in (np.linalg.lstsq(metric + ridge, off, rcond=None)[0], off / scale):  # the plain step always helps
            moved = sum((F.col(f"p_{d}") * F.lit(float(x)) for d, x in zip(used, step)), start=F.lit(0.0))
            trial = F.greatest(F.lit(0.0), rate - moved)
            found = measure(trial)
            if found[0] < distance:
                break
        gain = distance - found[0]
        if gain <= 0:
            break
        rate, (distance, off, metric) = trial, found
        if gain < SLOW * distance:
            break
    return rate


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, tokens, p_high, p_low, p_toxic, rate) of every row of `docs`."""
    scored = written(posteriors(docs.select("doc_id", "text"), labels).drop("text"))
    return scored.withColumn("rate", fit_rates(scored, targets))


def apply_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Rows of `docs` as often as their rates say: the fraction becomes a further copy by a draw for each row."""
    used = ("doc_id", "text")
    drawn = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(float(1 << 30))
    scored = written(posteriors(masked(docs, *used), labels).withColumn("drawn", drawn))
    copies = F.floor(fit_rates(scored, targets) + F.col("drawn")).cast("int")
    kept = scored.withColumn("copies", copies).where("copies > 0")
    return unmasked(kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns, *used)
