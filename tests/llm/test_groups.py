import random

import pytest

from tripleloom.llm import groups as G


def brute(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def run(spark, pairs, **extra):
    df = spark.createDataFrame(pairs, "a long, b long")
    return dict(G.match_groups(df).select("node", "group_id").collect())


CASES = {
    "chain": [(i, i + 1) for i in range(40)],
    "star": [(100, i) for i in range(30)],
    "cycle": [(i, (i + 1) % 9) for i in range(9)],
    "triangle and tail": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)],
    "clique": [(i, j) for i in range(6) for j in range(i)],
    "pair": [(5, 2)],
    "two hubs": [(1, i) for i in range(10, 20)] + [(2, i) for i in range(10, 20)],
    "dirty": [(1, 1), (None, 2), (3, None), (7, 8), (8, 7), (7, 8)],
}


@pytest.mark.parametrize("name", CASES)
def test_shapes(spark, name):
    assert run(spark, CASES[name]) == brute(CASES[name])


def test_empty(spark):
    assert run(spark, []) == {}


def test_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((60, 50), (60, 75)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        assert run(spark, pairs) == brute(pairs)


def test_entities_need_both_keys_in_the_document(spark):
    ents = spark.createDataFrame([(5, "d", "entity1", "x"), (5, "d", "entity1", "x"), (3, "d", "entity2", "y"), (9, "e", "entity1", "z"), (11, None, "entity1", "n")], "ent_id long, doc_id string, ent_key string, a string")
    pairs = spark.createDataFrame([("d", "entity1", "entity2", 1), ("d", "entity1", "entity7", 1), ("e", "entity1", "entity2", 1), (None, "entity1", "entity2", 1), ("d", "entity1", "entity1", 1)], "doc_id string, ent_a string, ent_b string, group_id int")
    assert sorted(map(tuple, G.entity_groups(ents, pairs).collect())) == [(3, 3), (5, 3), (9, 9), (11, 11)]
