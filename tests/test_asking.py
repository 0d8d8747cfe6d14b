"""Model-backed stages against hand-made answers: repair, retry, failure, and the checks on answers."""

import json
import random

import numpy as np
import pytest

from tripleloom.functions import text as T
from tripleloom.operators import linking, metrics, resolve, vectors
from tripleloom.plans import asking, backends
from tripleloom.sources import files
from pyspark.sql import functions as F


class Canned:
    """Answers by the first of its fragments that the prompt holds; a missing answer is empty."""

    answers: dict = {}

    def complete(self, prompts):
        return [next((a for k, a in self.answers.items() if k in p), "") for p in prompts]


def canned(answers):
    return type("Given", (Canned,), {"answers": answers})


class Down:
    def complete(self, prompts):
        raise OSError("no network")


@pytest.fixture(autouse=True)
def no_waits(monkeypatch):
    monkeypatch.setattr(backends.time, "sleep", lambda s: None)


def test_ask_json_repairs_once_and_asks_again_strictly(spark):
    given = canned({"Repair the JSON.\n\n{\"a\": [1": '{"a": [1]}', "Repair": "still bad", "valid JSON only": '{"late": 1}', "good": 'Sure:\n```json\n{"x": 2}\n```', "cut": '{"a": [1', "bad": "no json", "silent": ""})
    df = spark.createDataFrame([("good",), ("cut",), ("bad",), ("silent",), (None,), ("good",)], "q string")
    got = sorted((r.q or "", r.a) for r in asking.ask_json(df, "q", "a", given).collect())
    assert got == [("", None), ("bad", '{"late": 1}'), ("cut", '{"a": [1]}'), ("good", 'Sure:\n```json\n{"x": 2}\n```'), ("good", 'Sure:\n```json\n{"x": 2}\n```'), ("silent", '{"late": 1}')]


def test_judges(spark):
    df = spark.createDataFrame([(1, "A met B.", "Then A  met B here."), (2, "A met C.", None), (3, None, "x")], "i int, statement string, context string")
    assert [(r.i, r.verdict) for r in asking.judged(df).orderBy("i").collect()] == [(1, "SUPPORTED"), (2, "NOT_SUPPORTED"), (3, "MALFORMED")]
    assert [r.verdict for r in asking.judged(df, backend=Down).orderBy("i").collect()] == ["JUDGE_ERROR", "JUDGE_ERROR", "MALFORMED"]
    old = canned({"A met B": '{"verdict": "contradicted"}', "A met C": '{"verdict": "maybe"}'})
    assert [r.verdict for r in asking.judged(df, backend=old).orderBy("i").collect()] == ["NOT_SUPPORTED", "JUDGE_ERROR", "MALFORMED"]
    later = canned({"valid JSON only": "1", "A met": "hm"})
    facts = df.where("i < 3").withColumnRenamed("statement", "fact")
    assert {r.hit for r in asking.recalled(facts, backend=later).collect()} == {1}
    assert {r.hit for r in asking.recalled(facts, backend=Down).collect()} == {0}


def test_facts(spark):
    docs = spark.createDataFrame([(1, "Ann saw Rome. " * 20), (2, ""), (3, "Bob slept.")], "doc_id int, text string")
    got = asking.generated_facts(docs).collect()
    assert sum(r.doc_id == 1 for r in got) == 15 and not any(r.span_mismatch for r in got)
    assert [(r.fact, r.error) for r in got if r.doc_id == 2] == [(None, "no facts in the answer")]
    wrong = canned({"Bob": '{"facts": [{"fact": "Bob woke.", "supporting_span": "Bob woke"}]}'})
    assert [(r.fact, r.span_mismatch) for r in asking.generated_facts(docs.where("doc_id = 3"), backend=wrong).collect()] == [("Bob woke.", True)]
    facts = spark.createDataFrame([("Ann saw Rome.", "Ann saw Rome."), ("Ann sat.", "x"), (None, "x")], "fact string, context string")
    assert [r.verifier_verdict for r in asking.verified_facts(facts).orderBy("fact").collect()] == [None, "NOT_STATED", "SUPPORTED"]
    assert {(r.fact, r.category) for r in asking.classified_facts(facts).collect()} == {("Ann saw Rome.", "MULTI_ENTITY"), ("Ann sat.", "SINGLE_ENTITY"), (None, "AMBIGUOUS")}
    rows = [(v, m, e) for v in ("SUPPORTED", "CONTRADICTED", "NOT_STATED", "ODD", None) for m in (True, False, None) for e in ("x", None)]
    df = spark.createDataFrame(rows, "v string, m boolean, e string")

    def want(v, m, e):
        return "parse_error" if e or v is None else "span_not_in_text" if m else {"SUPPORTED": None, "CONTRADICTED": "contradicted", "NOT_STATED": "not_stated"}.get(v, "unknown_verdict")

    assert all(r.w == want(r.v, r.m, r.e) for r in df.withColumn("w", asking.drop_reason(F.col("v"), F.col("m"), F.col("e"))).collect())


def test_fixed_triples(spark):
    rows = [(1, "Ann", "met", "Bob"), (2, "Ann", "ann met", "Bob"), (3, "Ann", "ann", "Bob"), (4, "Ann", "of ann", "Bob")]
    df = spark.createDataFrame(rows, "triple_id int, subject string, relation string, object string")
    got = {r.triple_id: (r.relation, r.status, r.reason) for r in asking.fixed_triples(df).collect()}
    assert got == {1: ("met", "valid", None), 2: ("met", "fixed", None), 3: ("ann", "discarded", "incomplete"), 4: ("of", "fixed", None)}
    got = {r.triple_id: r.reason for r in asking.fixed_triples(df, backend=Down).collect()}
    assert got == {1: None, 2: "failed", 3: "failed", 4: "failed"}
    same = canned({"Fix": '{"relation": "still Ann"}'})
    assert {r.triple_id: r.reason for r in asking.fixed_triples(df, backend=same).collect()} == {1: None, 2: "still_invalid", 3: "still_invalid", 4: "still_invalid"}


def test_rewrites_end_in_the_entity(spark):
    t = spark.createDataFrame([(1, "d", "ann", "moved to", "the rome of old"), (2, "d", "ann", "saw", "rome")], "triple_id int, doc_id string, subject string, relation string, object string")
    names = spark.createDataFrame([("d", "Rome")], "doc_id string, name string")
    from tripleloom.session import cut

    done = cut(resolve.resolved(t, names, parts=True))
    get = lambda b: {r.triple_id: (r.relation, r.object) for r in asking.rewritten(done, b).collect()}
    assert get(backends.RuleBackend) == {1: ("moved to of old", "rome"), 2: ("saw", "rome")}
    assert get(canned({"Rewrite": "Ann moved in old times to Rome."}))[1] == ("moved in old times to", "rome")
    assert get(Down)[1] == ("moved to of old", "rome") and get(canned({"Rewrite": "Nothing here."}))[1] == ("moved to of old", "rome")


def test_matched_relations_and_pairs(spark):
    names = spark.createDataFrame([("d", "Ann Lee"), ("d", "Rome"), ("e", "Bob")], "doc_id string, name string")
    rows = [("d", "Ann Lee", "saw", "Rome"), ("d", "ann", "left", "old rome"), ("d", "nobody", "left", "Rome"), ("e", "Bob", "saw", "Rome")]
    got = asking.matched_relations(spark.createDataFrame(rows, "doc_id string, subject string, relation string, object string"), names)
    assert sorted((r.doc_id, r.subject, r.relation, r.object, r.fixed) for r in got.where("not fixed or subject <> object").collect()) == [("d", "Ann Lee", "left", "Rome", True), ("d", "Ann Lee", "saw", "Rome", False)]
    pairs = spark.createDataFrame([("A-b", "a B"), ("x", "y"), (None, "y"), ("", "")], "x string, y string")
    assert sorted((str(r.x), r.same) for r in asking.same_entity(pairs).collect()) == [("", False), ("A-b", True), ("None", False), ("x", False)]
    assert not any(r.same for r in asking.same_entity(pairs, backend=Down).collect())


def test_graphs_and_cluster_relations(spark):
    docs = spark.createDataFrame([(1, "Ann Lee met Bob in Rome. It rained. Eve slept.")], "doc_id int, text string")
    got = asking.entity_graphs(spark.createDataFrame([(1, "Ann Lee"), (1, None)], "doc_id int, name string"), docs, k=1)
    assert sorted((r.subject, r.object) for r in got.collect()) == [("Ann Lee", "Bob"), ("Ann Lee", "Rome")]
    members = spark.createDataFrame([("d", "c", n) for n in ("ann", "bob", "eve")] + [("d", "k", "ann")], "doc_id string, cluster string, name string")
    told = spark.createDataFrame([("d", "c", "Ann saw Bob. Eve slept."), ("d", "k", "x")], "doc_id string, cluster string, evidence string")
    assert [tuple(r) for r in asking.cluster_relations(members, told).collect()] == [("d", "c", "ann", "mentioned_with", "bob")]
    assert asking.cluster_relations(members, told, batch=2).count() == 1 and asking.cluster_relations(members, told, chars=5).count() == 0


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    ask = [(f"summary|{i}", f"Summarise the text.\n\ntext {i}") for i in range(6)]
    df = spark.createDataFrame(ask, "custom_id string, prompt string")
    asking.run_batch(spark, df.limit(4), str(tmp_path))
    got = asking.run_batch(spark, df, str(tmp_path), backend=Down).collect()
    assert sorted((r.custom_id, r.success) for r in got) == [(f"summary|{i}", i < 4) for i in range(6)]
    for bad in (df.limit(0), df.union(df), df.withColumn("custom_id", F.lit(" "))):
        with pytest.raises(ValueError):
            files.write_requests(bad, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        files.write_requests(df, str(tmp_path / "bad"), most_bytes=100)


def test_closed_json():
    rng = random.Random(2)
    text = json.dumps({"triples": [{"subject": f"a\\\"{i}", "n": [1, 2]} for i in range(5)]})
    for n in range(1, len(text)):
        out = backends.closed_json(text[:n])
        if text[:n].rstrip()[-1:] not in "\\-tfn0123456789":
            json.loads(out)
    assert json.loads(backends.closed_json('{"a": 1, "b": ')) == {"a": 1} and rng


def test_upsert_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    files.upsert(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, spark.read.parquet(path + ".bak").collect())) == [(1, "a"), (2, "b")]


def test_lemmas_and_content_words(spark):
    df = spark.createDataFrame([("The 3 Cities, buses & glasses of it is us",)], "t string")
    r = df.select(T.lemmas(F.col("t")).alias("a"), T.content_lemmas(F.col("t")).alias("b")).first()
    assert r.a == "the 3 cities, buse & glass of it is us" and r.b == ["city", "buse", "glass", "us"]


def test_context_vectors_and_token_scores(spark):
    names = spark.createDataFrame([("d", "a"), ("d", "b")], "doc_id string, entity string")
    told = spark.createDataFrame([("d", "a", 2, "y"), ("d", "a", 1, "x"), ("d", "a", 9, "z")], "doc_id string, entity string, k int, evidence string")
    embed = lambda df, text, out: df.withColumn(out, F.when(F.col(text).isNotNull(), F.array(F.length(text).cast("double"))))
    assert {r.entity: r.vector for r in linking.context_vectors(names, told, embed).collect()} == {"a": [2.0], "b": [1.0]}
    df = spark.createDataFrame([("red fox", "fox red"), ("red", "fox"), ("", "x"), (None, None)], "a string, b string")
    got = [tuple(r.s) for r in df.select(vectors.token_scores(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == pytest.approx((1, 1, 1)) and got[1][2] < 0.6 and got[2] == got[3] == (0, 0, 0)
    assert np.allclose(metrics.smoothed(np.ones(30)), 1)
