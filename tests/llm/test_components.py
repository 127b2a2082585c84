"""Connected components against union-find: chains, stars, random links, loops, repeats, none."""

import random

import pytest

from procura.llm.common import components


def roots(links):
    root = {x: x for link in links for x in link}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return {x: top(x) for x in root if top(x) != x}


_draw = random.Random(5)
GRAPHS = {
    "none": [],
    "loops": [(1, 1), (2, 2)],
    "stars": [(0, k) for k in range(1, 30)] + [(k, 40) for k in range(41, 60)] + [(0, 5)],
    "chain": [(k, k + 1) for k in range(40)],
    "shuffled chain": [((k * 17) % 41, ((k + 1) * 17) % 41) for k in range(40)],
    "random": [(_draw.randrange(150), _draw.randrange(150)) for _ in range(110)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    links = spark.createDataFrame(GRAPHS[name], "a long, b long")
    found = [(r.node, r.root) for r in components(links).collect()]
    assert len(found) == len(dict(found)) and dict(found) == roots(GRAPHS[name])
