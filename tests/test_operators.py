"""Small cases of single operators, with the edges that the tables may lack."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.functions import answers as A
from tripleloom.functions import records as R
from tripleloom.functions import text as T
from tripleloom.operators import cluster, components, graph, matching, metrics, resolve, segment, vectors


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [("  The  Big Red Barn ", "the big red"), ("", None), (" \t ", None), (None, None), ("Ünï Code", "ünï code")],
)
def test_clean_entity(spark, raw, want):
    assert one(spark, T.clean_entity(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw, want", [("66.67%", 66.67), (" 5 % ", 5.0), ("n/a", None), (None, None), ("", None)])
def test_percent(spark, raw, want):
    assert one(spark, T.percent(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw, want", [("supported", "SUPPORTED"), ("not supported", "NOT_SUPPORTED"), ("CONTRADICTED", "NOT_SUPPORTED"), ("not-stated", "NOT_SUPPORTED"), ("garbage", "JUDGE_ERROR"), ("", "JUDGE_ERROR"), (None, "JUDGE_ERROR")])
def test_verdict(spark, raw, want):
    assert one(spark, A.verdict(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw, want", [("true", 1), ("1", 1), ('"0"', 0), ("2", None), ("Yes.", 1), (None, None)])
def test_binary_verdict(spark, raw, want):
    assert one(spark, A.binary_verdict(F.col("a")), a=raw) == want


def test_answer_triples(spark):
    rows = [
        (1, '```json\n{"triples": [{"head": "a", "predicate": "b", "tail": "c"}, ["d", "e", "f"], {"subject": "x", "relation": " ", "object": "y"}]}\n```'),
        (2, 'Here: [["g", "h", "i"]] done'),
        (3, '{"triples": [{"subject": "a"'),
        (4, None),
    ]
    got = A.answer_triples(spark.createDataFrame(rows, "id int, t string"), "t", ["id"]).select("id", "subject", "relation", "object").collect()
    assert sorted(map(tuple, got)) == [(1, "a", "b", "c"), (1, "d", "e", "f"), (2, "g", "h", "i")]


def test_bounded_places(spark):
    text, term = F.col("a"), F.col("b")
    assert one(spark, matching.all_places(text, term), a="vivo and vivotab, vivo rt", b="vivo") == [0, 18]
    assert one(spark, matching.all_places(text, term), a="c++ and c++", b="c++") == [0, 8]
    assert one(spark, matching.first_place(text, term), a="see the cat", b="cat") == 8
    assert one(spark, matching.first_place(text, term), a="concat", b="cat") is None


def test_longest_terms_win(spark):
    texts = spark.createDataFrame([(1, "d", "microsoft windows and windows"), (2, "d", "нет таких"), (3, "e", "windows")], "id int, g string, t string")
    terms = spark.createDataFrame([("d", "windows"), ("d", "microsoft windows"), ("d", "таких"), ("d", "win")], "g string, n string")
    got = {r.id: [(s.st, s.term) for s in r.found] for r in matching.matches(texts, terms, ["id"], "g", "t", "n").collect()}
    assert got == {1: [(0, "microsoft windows"), (22, "windows")], 2: [(4, "таких")]}


def test_resolution(spark):
    triples = spark.createDataFrame(
        [(1, "d", "ann", "lives", "in the town of rome"), (2, "d", "ann", "likes", "Rome"), (3, "d", "ann", "saw", "rome by night"), (4, "d", "ann", "met", "rome and bob"), (5, "d", "ann", "has", "nothing"), (6, "d", "x", "y", None)],
        "triple_id int, doc_id string, subject string, relation string, object string",
    )
    names = spark.createDataFrame([("d", "Rome"), ("d", "Bob"), ("e", "nothing")], "doc_id string, name string")
    got = {r.triple_id: (r.relation, r.object, r.method) for r in resolve.resolved(triples, names).collect()}
    assert got[1] == ("lives in the town of", "rome", "prefix")
    assert got[2] == ("likes", "Rome", "exact")
    assert got[3] == ("saw by night", "rome", "rewrite")
    assert got[4][2] == "multi" and got[5] == ("has", "nothing", "none") and got[6][2] == "none"


def test_char_packing():
    assert segment.pack_chars(["aa bb", "cc"], 8) == ["aa bb cc"]
    assert segment.pack_chars(["aa bb", "ccc"], 8) == ["aa bb", "ccc"]
    assert segment.pack_chars(["a" * 12, "b b b"], 4) == ["a" * 12, "b b", "b"]
    assert segment.pack_chars([], 5) == []


@pytest.mark.parametrize("n, want", [(300, [300]), (301, [300, 51]), (551, [300, 300, 51]), (0, [])])
def test_paragraph_windows(n, want):
    assert [len(c.split()) for c in segment.pack_paragraphs(" ".join(["w"] * n))] == want


def test_paragraph_carry():
    chunks = segment.pack_paragraphs("\n\n".join([" ".join(f"p{k}w{i}" for i in range(200)) for k in range(2)]))
    assert [len(c.split()) for c in chunks] == [200, 250] and chunks[1].startswith("p0w150 ")


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 13), (13, 14), (7, 7), (None, 3)]
    got = dict(components.star_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    assert components.star_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_threshold_clusters(spark):
    items = spark.createDataFrame([(0, i) for i in range(4)], "g int, i long")
    pairs = spark.createDataFrame([(0, 0, 1, 0.85), (0, 1, 2, 0.80)], "g int, i long, j long, sim double")
    uir = cluster.information_ratio(cluster.threshold_clusters(items, pairs, "g", "i"), "g").first()
    assert (uir.n_items, uir.n_clusters, uir.uir) == (4, 2, 0.5)


def test_similar_pairs_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 2), int(i), [float(x) for x in rng.standard_normal(6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, i long, v array<double>")
    old, vectors.BLOCK = vectors.BLOCK, 7
    try:
        got = {(r.g, r.i, r.j) for r in vectors.similar_pairs(df, "g", "i", "v", 0.5).collect()}
    finally:
        vectors.BLOCK = old
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    assert got == {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and cos(a[2], b[2]) >= 0.5}


def test_assignment_is_best():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (2, 4), (4, 2)):
        s = rng.random((n, m))
        small, big = min(n, m), max(n, m)
        best = max(sum(s[i, p[i]] if n <= m else s[p[i], i] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert math.isclose(sum(s[i, j] for i, j in vectors.assignment(s)), best)


def test_density_labels():
    x = np.array([[0, 0], [0, 0.01], [0.01, 0], [5, 5], [5, 5.01], [5.01, 5], [50, 0]], float)
    got = cluster.density_labels(x)
    assert len(set(got[:3])) == 1 and len(set(got[3:6])) == 1 and got[0] != got[3] and got[6] == -1


def test_strong_components_and_betweenness():
    comps = graph.strong_components("abcd", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    assert sorted(map(sorted, comps)) == [["a", "b", "c"], ["d"]]
    assert graph.betweenness(list("abc"), [("a", "b"), ("b", "c")]) == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_pagerank_sums_to_one(spark):
    got = dict(graph.pagerank(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("a", "b")], "src string, dst string"), 30).collect())
    assert math.isclose(sum(got.values()), 1, rel_tol=1e-9) and got["c"] > got["b"]


def test_p_value():
    # tabulated: t = 2.228 with 10 degrees of freedom leaves 0.05
    assert abs(metrics._tail(2.2281388, 10) - 0.05) < 1e-6


def test_indel_ratio():
    assert metrics.indel_ratio("ab", "abcd") == 67 and metrics.indel_ratio("", "") == 100 and metrics.indel_ratio("a", "b") == 0


def test_faithfulness_leaves_out_documents_without_an_evaluated_row(spark):
    rows = [("a", "MALFORMED"), ("a", "JUDGE_ERROR"), ("b", "SUPPORTED"), ("b", "NOT_SUPPORTED")]
    per = metrics.faithfulness_per_doc(spark.createDataFrame(rows, "doc_id string, verdict string"), ["doc_id"])
    got = metrics.faithfulness_dataset(per.withColumn("k", F.lit(1)), ["k"]).first()
    assert (got.n_docs, got.n_evaluated, got.macro, got.macro_std, got.micro) == (2, 2, 0.5, 0.0, 0.5)


def test_kg_triples(spark):
    body = json.dumps({"central_entity": {"name": "a", "type": "t", "relationships": [{"relation": "r", "target_name": "b"}, {"relation": "s", "target_name": ["c", "d"]}]}})
    got = R.kg_triples(spark.createDataFrame([(1, body), (2, None), (3, "{")], "id int, p string"), "p", ["id"]).collect()
    assert sorted(map(tuple, got)) == [(1, "a", "r", "b"), (1, "a", "s", "c"), (1, "a", "s", "d")]
