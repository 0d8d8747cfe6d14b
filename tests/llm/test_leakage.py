import pytest

from tripleloom.llm import leakage as K

ITEM = "the quick brown fox jumps over the lazy dog and then runs home to sleep until morning"
HAN = "萨特普模型在三十一项任务上优于其他所有模型而且速度也更快一些结果稳定"
W = ITEM.split()


def run(spark, docs, items=((1, "en", ITEM), (2, "zh", HAN), (3, "en", "too short"), (4, None, None))):
    d = spark.createDataFrame([r + ("x", "y") for r in docs], "doc_id long, text string, lang string, term string")
    i = spark.createDataFrame(list(items), "item_id long, lang string, text string")
    return sorted(map(tuple, K.exact_leaks(d, i).collect()))


def test_exact(spark):
    docs = [
        (10, "so " + " ".join(W[2:14]) + " etc"),
        (11, " ".join(W[2:13])),  # eleven words
        (12, " ".join(reversed(W))),
        (13, "*" + ",\n".join(w.upper() for w in W[:12])),
        (14, " ".join(W[:6]) + " x " + " ".join(W[6:14])),
        (15, "前 " + HAN[3:27] + "后"),
        (16, HAN[3:26]),
        (17, " ".join(W[:12]).replace("o", "о").replace("e", "e\u0301").replace("q", "q\u200b")),
        (18, None),
        (19, ""),
        (None, ITEM),
        (20, ITEM),
        (20, ITEM),
        (21, "pad " * 50_000 + ITEM),
    ]
    assert run(spark, docs) == [(1, 10), (1, 13), (1, 17), (1, 20), (1, 21), (2, 15)]


def test_empty_sides(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, ITEM)], [(5, "en", "")]) == []


def test_near(spark):
    d = spark.createDataFrame([(1, " ".join(W[:7]) + " x " + " ".join(W[7:])), (2, ITEM)], "doc_id long, text string")
    i = spark.createDataFrame([(1, "en", ITEM)], "item_id long, lang string, text string")
    got = {r.doc_id: (r.kind, r.longest, r.matched) for r in K.leak_report(d, i).collect()}
    assert got == {1: ("near", 10, 17), 2: ("exact", 17, 17)}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_large_vocabularies_are_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(K, "BROADCAST_TERMS", limit)
    assert run(spark, [(1, ITEM)]) == [(1, 1)]


def report(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, lang string, text string")
    return {(r.item_id, r.doc_id): (r.kind, r.longest, r.matched) for r in K.leak_report(d, i).collect()}


def test_near_with_a_word_of_the_item_alone(spark, monkeypatch):
    ws = [f"w{i}" for i in range(23)]
    changed = " ".join([*ws[:11], "other", *ws[12:]])
    every_third = " ".join(w if i % 3 else f"x{i}" for i, w in enumerate(ws))
    docs = [(1, changed), (2, every_third), (3, " ".join(ws[:11])), (4, "pad " * 9000 + changed + " pad" * 9000)]
    docs += [(5, HAN[:12] + "新" + HAN[13:])]
    items = [(1, "en", " ".join(ws)), (2, "zh", HAN)]
    want = {(1, 1): ("near", 11, 22), (1, 2): ("near", 2, 15), (1, 4): ("near", 11, 22), (2, 5): ("near", len(HAN) - 13, len(HAN) - 1)}
    assert report(spark, docs, items) == want
    monkeypatch.setattr(K, "BROADCAST_TERMS", 10)
    monkeypatch.setattr(K, "BLOCK", 7)
    assert report(spark, docs, items) == want
