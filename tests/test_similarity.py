"""Similarity joins against brute force on small vocabularies."""

import random

from pyspark.sql import functions as F

from procura.functions.text import ingredient_typo_limit, search_typo_limit
from procura.operators import match
from procura.operators.match import _long_query
from procura.operators.similarity import subset_pairs, typo_pairs
from procura.plans import bridge


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in sorted(set(values))], "key string")


def mutate(rng, word):
    for _ in range(rng.randint(0, 4)):
        at = rng.randint(0, len(word))
        kind = rng.choice("ids")
        if kind == "i":
            word = word[:at] + rng.choice("abc ") + word[at:]
        elif word[at:]:
            word = word[:at] + ("" if kind == "d" else rng.choice("abc")) + word[at + 1 :]
    return word


def test_typo_pairs_find_everything(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 34))) for _ in range(50)]
    cands = base + [mutate(rng, w) for w in base]
    cands = [w for w in cands if w]
    queries = [w for w in (mutate(rng, x) for x in base * 2) if w]
    got = {tuple(r) for r in typo_pairs(keys(spark, queries), keys(spark, cands), ingredient_typo_limit, _long_query).collect()}
    want = {
        (q, x, distance(q, x)) for q in set(queries) for x in set(cands) if distance(q, x) <= max(1, len(q) // 7)
    }
    assert got == want and len(want) > 50


def test_search_words_find_everything(spark):
    rng = random.Random(6)
    cands = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(70)]
    queries = [w for w in (mutate(rng, x) for x in cands) if w]
    longest = lambda n: F.floor((n + 1) * 3 / 2).cast("int") + 2
    got = {tuple(r) for r in typo_pairs(keys(spark, queries), keys(spark, cands), search_typo_limit, longest).collect()}
    limit = lambda q: max(2, -(-len(q) // 3))
    want = {(q, x, distance(q, x)) for q in set(queries) for x in set(cands) if distance(q, x) <= limit(q)}
    assert got == want


def test_subset_pairs_with_repeated_words(spark):
    rng = random.Random(7)
    make = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    queries, cands = [make() for _ in range(60)], [make() for _ in range(60)]
    got = {tuple(r) for r in subset_pairs(keys(spark, queries), keys(spark, cands)).collect()}

    def fits(q, x):
        a, b = q.split(), x.split()
        if len(a) == len(b) or abs(len(a) - len(b)) > 2:
            return False
        few, many = (a, b) if len(a) < len(b) else (b, a)
        return set(few) <= set(many)

    assert got == {(q, x) for q in set(queries) for x in set(cands) if fits(q, x)}


def test_a_family_has_each_product_once_and_its_catalogue_is_not_broadcast(spark):
    products = bridge.products(spark, "/root/testdata/sf0.001")
    matches = products.select(F.col("standard_name").alias("text"), F.lit(match.ANY_SECTOR).alias("sector"), F.col("generic_key").alias("matched_generic_key"))
    found = match.matched_products(matches.distinct(), products.unionAll(products))
    assert "rightHint=(strategy=merge)" in found._jdf.queryExecution().optimizedPlan().toString()
    want = matches.distinct().join(products, F.col("matched_generic_key") == F.col("generic_key")).select("text", "product_id").distinct()
    assert found.count() == want.count()
