"""Relations matched to the names of their document: against brute force, as prompts, dealt to parts, and what they store."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tripleloom.operators import names as N
from tripleloom.plans import asking, backends
from tripleloom.session import shared_folder

FOUND = "doc_id string, subject string, relation string, object string"
ODD = ["a b", "B\tc", 'q"uo te', "back\\slash c", "nul\x01 \x1f a", "  ı İ c", "", "  ", "é/ü c", "b b", "\U0001f600 a"]


def folder_size(spark):
    at = shared_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(at) for f in fs)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_lists_of_common_words_are_not_stored(spark):
    n = 1500
    names = spark.createDataFrame([("d", f"n{i} river") for i in range(n)], "doc_id string, name string")
    found = spark.createDataFrame([("d", f"n{i} the river", "by", f"old N{i} River") for i in range(n)], FOUND)
    before = folder_size(spark)
    got = asking.matched_relations(found, names).collect()
    assert {(r.subject, r.object, r.fixed) for r in got} == {(f"n{i} river", f"n{i} river", True) for i in range(n)}
    assert folder_size(spark) - before < 3_000_000


def test_a_missing_end_leaves_the_others_their_answers(spark, monkeypatch):
    monkeypatch.setattr(backends.time, "sleep", lambda s: None)
    names = spark.createDataFrame([("d", "Ann Lee"), ("d", "Rome"), (None, "x"), ("d", None)], "doc_id string, name string")
    rows = [("d", "ann", "left", "old rome"), ("d", None, "left", "rome"), ("d", "Ann Lee", None, "Rome"), ("d", "ann", None, "rome"), (None, "x", "y", "x"), ("e", "Rome", "y", "Rome")]
    got = asking.matched_relations(spark.createDataFrame(rows, FOUND).repartition(1), names).collect()
    assert sorted((r.subject, str(r.relation), r.object, r.fixed) for r in got) == [("Ann Lee", "None", "Rome", False), ("Ann Lee", "left", "Rome", True)]


def test_nearest_is_that_of_the_whole_list(monkeypatch):
    monkeypatch.setattr(N, "FEW", 3)
    rng = random.Random(1)
    text = lambda: rng.choice([" ", ""]) + " ".join(rng.choice("abcdefghijkl") + rng.choice(["", "", "x"]) for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])))
    for k in range(300):
        names = N.Names({text().title() if rng.random() < 0.3 else text() for _ in range(rng.randrange(40))} | set(ODD[: k % 12]))
        for _ in range(30):
            a, b = text(), rng.choice([None, text(), rng.choice(ODD)])
            assert names.listed(a, b) == sorted(n for n in names.known if N.words(n) & (N.words(a) | N.words(b)))
            for x, y in ((a, b), (b, a)):
                assert names.nearest(x, y) == backends._nearest(x, names.listed(a, b))


def test_prompts_are_those_of_to_json(spark):
    rows = [("d", a, r, b) for a in ODD for b in ODD[:4] for r in ('x "y"\n', None)] + [("d", None, "r", "a")]
    found = spark.createDataFrame(rows, FOUND).distinct()
    want = asking.prompt("Match the ends of the relation to the entities.", subject=F.col("subject"), relation=F.col("relation"), object=F.col("object"), entities=F.array().cast("array<string>"))
    lists = N.Names(ODD)
    for r in found.withColumn("p", want).collect():
        assert backends.Ends(r.subject, r.relation, r.object, N.Names([])).prompt() == r.p
        text = backends.Ends(r.subject, r.relation, r.object, lists).prompt()
        assert text.startswith(r.p[: -len("[]}")]) and json.loads(text[text.index("{") :])["entities"] == lists.listed(r.subject, r.object)
    listed = spark.createDataFrame([(ODD,)], "n array<string>").select(F.to_json(F.struct(F.array_sort("n").alias("n")))).first()[0]
    assert "[" + ",".join(map(backends.quoted, sorted(ODD))) + "]" == listed.partition(":")[2][:-1]


@pytest.mark.parametrize("part", [5000, 2])
def test_prompts_and_lists_answer_alike_in_any_parts(spark, part, monkeypatch):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdef") for _ in range(rng.choice([1, 2, 2, 3])))
    names = [(d, text().upper() if rng.random() < 0.5 else text()) for d in "de" for _ in range(15)]
    rows = [(d, text(), rng.choice("rs"), text()) for d in "dddef" for _ in range(12)] + [("d", a, "r", "a") for a in ODD]
    found, listed = spark.createDataFrame(rows, FOUND), spark.createDataFrame(names, "doc_id string, name string")
    own = lambda d: N.Names({n for k, n in names if k == d})
    want = set()
    for d, s, r, o in rows:
        x = own(d)
        if s in x.known and o in x.known:
            want.add((d, s, r, o, False))
        elif x.known:
            both = x.listed(s, o)
            a, b = backends._nearest(s, both), backends._nearest(o, both)
            if a in x.known and b in x.known:
                want.add((d, a, r, b, True))
    monkeypatch.setattr(asking, "PART", part)
    read = type("Read", (), {"complete": lambda self, prompts: backends.RuleBackend().complete(prompts)})
    for backend in (backends.RuleBackend, read):
        got = asking.matched_relations(found, listed, backend).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_answers_are_repaired_then_asked_again(spark):
    given = {"Repair the JSON.\n\n{\"subject\": \"Ann Lee\"": '{"subject": "Ann Lee", "relation": "mended", "object": "Rome"}', "valid JSON only": '{"subject": "Ann Lee", "predicate": "late", "object": "Rome"}', "cut": '{"subject": "Ann Lee"', "silent": "", "bad": "no json", "Match": '{"subject": "Ann Lee", "relation": "wrong", "object": "Paris"}'}
    canned = type("Given", (), {"complete": lambda self, prompts: [next((a for k, a in given.items() if k in p), "") for p in prompts]})
    names = spark.createDataFrame([("d", "Ann Lee"), ("d", "Rome"), ("e", "Ann Lee"), ("e", "Rome")], "doc_id string, name string")
    found = spark.createDataFrame([("d", "ann", "cut", "rome"), ("e", "ann", "silent", "rome"), ("d", "ann", "bad", "rome"), ("d", "ann", "left", "rome")], FOUND)
    assert rows_of(asking.matched_relations(found, names, canned)) == rows_of(spark.createDataFrame([("d", "Ann Lee", "mended", "Rome", True), ("d", "Ann Lee", "late", "Rome", True), ("e", "Ann Lee", "late", "Rome", True)], FOUND + ", fixed boolean"))
