"""Scans and sinks on a few files."""

import json

import pytest
from pyspark.sql import functions as F

from tripleloom.sources import files


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_texts_in_number_order(spark, tmp_path):
    for n in ("doc_10", "doc_2", "other"):
        put(tmp_path / f"{n}.txt", f"text of {n}\nline")
    got = files.scan_texts(spark, str(tmp_path)).orderBy(*files.doc_order(F.col("doc_id"))).collect()
    assert [r.doc_id for r in got] == ["doc_2", "doc_10", "other"] and got[0].text == "text of doc_2\nline"


def test_final_output_with_fallback(spark, tmp_path):
    put(tmp_path / "a" / "final_output.json", {"triples_final": [{"subject": " x ", "relation": "r", "object": "y", "evidence": "e"}, {"subject": "", "relation": "r", "object": "y"}]})
    put(tmp_path / "b" / "final_output.json", {"triples_final": [], "chunks": [{"relations": [{"head": "h", "predicate": "p", "tail": "t"}]}, {"relations": None}]})
    got = files.scan_final_output(spark, str(tmp_path)).select("doc_id", "subject", "relation", "object").collect()
    assert sorted(map(tuple, got)) == [("a", "x", "r", "y"), ("b", "h", "p", "t")]


def test_flat_graphs(spark, tmp_path):
    put(tmp_path / "1.json", {"relations": [["a", "b", "c"]], "edges": ["b"]})
    put(tmp_path / "2.json", {"relations": [], "edges": ["x"], "triples_final": [{"subject": "s", "relation": "r", "object": "o"}]})
    got = files.scan_flat_graphs(spark, str(tmp_path)).select("doc_id", "subject", "relation", "object").collect()
    assert sorted(map(tuple, got)) == [("1", "a", "b", "c"), ("2", "s", "r", "o")]


def test_gold_facts_and_results(spark, tmp_path):
    put(tmp_path / "f" / "d.json", {"facts": ["x", "y", "z"], "single-entity": [1], "multiple-entity": [0], "ambiguous": [2]})
    got = files.scan_gold_facts(spark, str(tmp_path / "f")).orderBy("fact_ord").collect()
    assert [(r.fact, r.label) for r in got] == [("x", "multi"), ("y", "single"), ("z", "multi")]
    put(tmp_path / "r" / "results_3.json", [{"evaluation": 1}, {"evaluation": 0}, {"accuracy": "50.00%"}])
    assert tuple(files.scan_results(spark, str(tmp_path / "r")).first()) == ("results_3", 2, 1, 50.0)


def test_cache_keeps_the_last_line(spark, tmp_path):
    put(tmp_path / "c.jsonl", '{"custom_id": "a", "v": 1}\n\n{"custom_id": "b", "v": 5}\nbroken{\n{"custom_id": "a", "v": 2}\n')
    got = files.scan_cache(spark, str(tmp_path / "c.jsonl"), "custom_id string, v int").collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("b", 5)]


def test_logs(spark, tmp_path):
    put(tmp_path / "logs" / "exp1" / "deep" / "x.log", "one\ntwo\n")
    got = files.scan_logs(spark, str(tmp_path / "logs")).collect()
    assert sorted(map(tuple, got)) == [("exp1", "one"), ("exp1", "two")]


def test_paired_lines(spark, tmp_path):
    put(tmp_path / "a", "1\n\n2\n")
    put(tmp_path / "b", "x\ny\n")
    got = files.paired_lines(spark, str(tmp_path / "a"), str(tmp_path / "b")).orderBy("line_no").collect()
    assert [(r.a, r.b) for r in got] == [("1", "x"), ("2", "y")]
    put(tmp_path / "b", "x\n")
    with pytest.raises(Exception, match="differ in length"):
        files.paired_lines(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "custom_id string, v int")
    files.write_requests(df, str(tmp_path / "q"))
    with pytest.raises(ValueError):
        files.write_requests(df.union(df), str(tmp_path / "q2"))
    df.write.parquet(str(tmp_path / "u"))
    files.upsert(spark, str(tmp_path / "u"), spark.createDataFrame([("b", 9), ("c", 3)], df.schema), "custom_id")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "u")).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    e = spark.createDataFrame([("x", "r", "y", None)], "src string, rel string, dst string, evidence string")
    for _ in range(2):
        files.write_graph(e, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/vertices")).count() == 2 and spark.read.parquet(str(tmp_path / "g/edges")).count() == 2
