import pytest

from tripleloom.llm import lookalike as L


def forms(texts):
    counts = {}
    for t in texts:
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    rewrite = L.rewriter(L.rules(counts))
    return [rewrite(t) for t in texts]


def test_same_looks():
    groups = [
        ["cafe\u0301 ole", "café ole", "сafé оlе", "ｃａｆé ole", "ca\u200bfé\u00a0ole"],
        ["office-x", "oﬃce\u2011x"],
        ["ガ", "ｶ\uff9e", "カ\u3099"],
        ["й", "и\u0306"],
        ["น้ำ", "น้ํา"],
    ]
    out = forms([t for g in groups for t in g])
    at = 0
    for g in groups[:4]:
        assert len(set(out[at : at + len(g)])) == 1, g
        at += len(g)


def test_different_looks():
    out = forms(["Cafe", "cafe", "café", "cafe ", "cafe\n", "caf3", "ca  fe", "ca fe"])
    assert len(set(out)) == len(out)


def test_pairs(spark):
    rows = [(1, "one"), (2, "оne"), (3, "one"), (4, "two"), (5, None), (6, ""), (7, "\u200b"), (1, "one"), (None, "one"), (8, "two")]
    df = spark.createDataFrame([r + ("x",) for r in rows], "doc_id long, text string, look string")
    assert sorted(map(tuple, L.same_look_pairs(df).collect())) == [(1, 2), (2, 3), (6, 7)]
    assert L.same_look_pairs(df.limit(0)).count() == 0


def test_most_used_member_stands_for_its_class():
    assert forms(["аа а", "a"])[1] == "а" and forms(["aa a", "а"])[1] == "a"


def test_very_long_text():
    assert forms(["x" * 300_000 + "é", "x" * 300_000 + "e\u0301"])[0] == forms(["x" * 300_000 + "é", "x" * 300_000 + "e\u0301"])[1]


def test_strings_of_many_documents_are_dealt_out(spark, monkeypatch):
    texts = ["one", "оne", "ｏne", "two", "twо"]
    rows = [(i, texts[(i * 7) % 9 % 5]) for i in range(120)]
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and x != y and (x in texts[:3]) == (y in texts[:3]))
    monkeypatch.setattr(L, "DEALT", 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, L.same_look_pairs(df).collect())) == want
    got = {(r.look_id, r.string_id, r.id) for r in L.look_members(df).collect()}
    first = {t: min(i for i, x in rows if x == t) for t in texts}
    looks = {t: min(first[x] for x in texts if (x in texts[:3]) == (t in texts[:3])) for t in texts}
    assert got == {(looks[t], first[t], i) for i, t in rows}


def test_many_passes_and_pairs_of_the_caller():
    # each mark meets the letter before it only after the pass before
    deep = "a" + "́​" * 12
    assert len(set(forms([deep, deep.replace("​", "")]))) == 1
    counts = {c: 1 for c in "abcx"}
    rewrite = L.rewriter(L.rules(counts, [("a", "b"), ("b", "c")]))
    assert len({rewrite(t) for t in ("xa", "xb", "xc")}) == 1


def test_rules_that_chase_each_other_raise():
    with pytest.raises(ValueError):
        L.rewriter({"ab": "ba", "ba": "ab"})("abx")


def test_tags_and_variation_selectors_show_nothing():
    assert len(set(forms(["x\U000e0041y", "xy", "x\U000e0100y"]))) == 1
