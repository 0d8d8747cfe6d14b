import pytest
from pyspark.sql import functions as F

from tripleloom.llm import dressed as D


@pytest.mark.parametrize("a, b, same", [("A-b c", "abC", True), ("v2.1", "v21", False), ("v2.1", "V2.1!", True), ("end.", "end", True), ("é", "e", False), ("Straße", "STRASSE", True), ("a_b", "ab", True), ("a b", "ab", True)])
def test_canonical(spark, a, b, same):
    x, y = spark.createDataFrame([(a, b)], "a string, b string").select(D.canonical(F.col("a")), D.canonical(F.col("b"))).first()
    assert (x == y) == same


ROWS = [
    (1, "A", "is", "B", None),
    (2, "a!", "IS", " b", None),
    (2, "a!", "IS", " b", None),  # delivered twice
    (3, None, None, None, '{"tail": "b", "head": "A", "predicate": "is", "more": 1}'),
    (4, None, None, None, '{"tail": "b", "head": "A"'),
    (5, "B", "is", "A", None),
    (6, " ", "is", "B", None),
    (7, None, "is", "B", None),
    (8, None, None, None, None),
    (None, "a", "is", "b", None),
    (9, "aisb", "is", "B", None),
    (10, "x" * 100_000, "y", "z", None),
]
SCHEMA = "triple_id long, subject string, relation string, object string, payload string"


@pytest.mark.parametrize("hot", [False, True])
def test_copies(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(D, "LEAST_HOT", 1)
        monkeypatch.setattr(D, "HOT_FACTOR", 10**9)
    df = spark.createDataFrame([r + (i, i) for i, r in enumerate(ROWS)], SCHEMA + ", id int, k1 int")
    assert sorted(map(tuple, D.triple_copies(df).collect())) == [(1, 2), (1, 3)]


def test_empty(spark):
    assert D.triple_copies(spark.createDataFrame([], SCHEMA)).count() == 0
