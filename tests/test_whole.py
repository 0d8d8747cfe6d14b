"""Cases in which a shortcut of an operator would lose rows."""

import random

import numpy as np
import pytest

from tripleloom.functions import records
from tripleloom.operators import cluster, graph
from tripleloom.plans import graph_queries, pipeline

PARTS = "triple_id long, doc_id string, chunk_id int, triple_ord int, subject string, relation string, object string, evidence string, payload string, pipeline string, origin string"


def test_payload_triples_reach_the_graph(spark, tmp_path):
    rows = [
        (1, "a", "r", "b", None),
        (2, None, None, None, '{"tail": "a", "predicate": "r", "head": "b", "x": 1}'),
        (2, None, None, None, '{"tail": "a", "predicate": "r", "head": "b", "x": 1}'),
        (3, None, None, None, '{"head": "b"'),
        (4, "b", None, "c", None),
    ]
    rows = [(i, "d", 1, 1, s, r, o, None, p, "ours", "extracted") for i, s, r, o, p in rows]
    spark.createDataFrame(rows, PARTS).write.parquet(str(tmp_path / "triples.parquet"))
    got = graph_queries.graph_structure(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.n_strong, r.largest_strong) for r in got] == [("d", 1, 2)]
    assert {r.v for r in graph_queries.pagerank(spark, str(tmp_path)).collect()} == {"a", "b"}


@pytest.mark.parametrize("limit", [0, 12])
def test_large_groups_get_their_strong_components(spark, monkeypatch, limit):
    rng = random.Random(7)
    rows = [("a", f"v{i}", f"v{(i + 1) % 9}") for i in range(9)] + [("b", f"v{i}", f"v{i + 1}") for i in range(6)] + [("b", "v2", "v2"), ("b", "self", "self")]
    rows += [("c", f"v{rng.randrange(30)}", f"v{rng.randrange(30)}") for _ in range(45)]
    df = spark.createDataFrame(rows, "doc_id string, src string, dst string")
    key = lambda r: (r.doc_id, r.n_strong, r.largest_strong)
    want = sorted(map(key, graph.group_structure(df, "doc_id").collect()))
    assert want[:2] == [("a", 1, 9), ("b", 8, 1)]
    monkeypatch.setattr(graph, "GROUP_EDGES", limit)
    assert sorted(map(key, graph.group_structure(df, "doc_id").collect())) == want


def test_probes_of_any_script_and_length_find_their_document(spark):
    han = "".join(chr(0x4E00 + 7 * i) for i in range(300))
    five = " ".join(f"{'abcdefghij'[i % 10] * 14}{i}" for i in range(40))
    items = [(1, han), (2, five), (3, "ab cd ef"), (4, "x" + han[::-1])]
    docs = [(7, "前。" + han + "后"), (8, "so " + five), (9, "the ab cd ef gh"), (10, han[:100] + "新" + han[101:150])]
    got = records.best_probe(spark.createDataFrame(items, "item long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 7, "probes"), (2, 8, "probes"), (3, 9, "probes")]


class Blank:
    def complete(self, prompts):
        return ['{"triples": [{"subject": "ann", "relation": "met", "object": "rome"}]}' for _ in prompts]


def test_objects_of_several_entities_are_split(spark):
    rows = [(1, "d", "ann", "met", "old rome, bob and eve"), (2, "d", "ann", "is", "part of rome within gaul"), (3, "d", "ann", "saw", "rome"), (4, "d", "", "saw", "rome and bob")]
    df = spark.createDataFrame(rows, "triple_id int, doc_id string, subject string, relation string, object string")
    names = spark.createDataFrame([("d", n) for n in ("Rome", "Bob", "Eve", "Gaul")], "doc_id string, name string")
    got = lambda b: sorted((r.triple_id, r.part, r.subject, r.relation, r.object, r.status) for r in pipeline.repaired(df, names, b).collect())
    kept = [(3, 0, "ann", "saw", "rome", "repaired"), (4, 0, "", "saw", "rome and bob", "failed")]
    hub = [(1, k, "ann", "met old", o, "repaired") for k, o in enumerate(("rome", "bob", "eve"))]
    chain = [(2, 0, "ann", "is part of", "rome", "repaired"), (2, 1, "rome", "within", "gaul", "repaired")]
    assert got(pipeline.RuleBackend) == hub + chain + kept
    assert got(Blank) == [(i, 0, s, r, o, "repaired" if i == 3 else "failed") for i, _, s, r, o in rows]


def test_clusters_of_large_groups(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(8, 6))[rng.integers(0, 8, 4100)] + rng.normal(scale=0.05, size=(4100, 6))
    rows = [(1, i, v.tolist()) for i, v in enumerate(m)] + [(2, i, v.tolist()) for i, v in enumerate(m[:50])]
    df = spark.createDataFrame(rows, "label int, vec_id int, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    args = (df, "label", "vec_id", "embedding")
    for got, how in ((cluster.leader_clusters(*args, 0.6), lambda x: cluster.leader_labels(x, 0.6)), (cluster.per_group(*args, cluster.density_labels), cluster.density_labels)):
        got = {(r.label, r.vec_id): r.cluster for r in got.collect()}
        want = {(g, i): int(c) for g, x in ((1, unit), (2, unit[:50])) for i, c in enumerate(how(x))}
        assert got == want
