import numpy as np
import pytest

from tripleloom.llm import packing as P
from tripleloom.llm.tokens import tokenizer


def test_hilbert_is_a_walk():
    side = 8
    cells = np.array([(x, y) for x in range(side) for y in range(side)])
    keys = P.hilbert(cells, 3)
    assert sorted(keys) == list(range(side * side))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, n, i % 3) for i, n in enumerate(sizes)], "id long, n_tokens long, curve long")
    return P.containers(df, capacity).collect()


def test_every_token_once_and_no_overflow(spark):
    sizes = [1, 5, 10, 11, 20, 25, 0, 7, 3, 3, 3]
    got = packed(spark, sizes, 10)
    room = {}
    for r in got:
        room[r.container_id] = room.get(r.container_id, 0) + r.tok_end - r.tok_start
    assert max(room.values()) <= 10
    for i, n in enumerate(sizes):
        mine = sorted((r.tok_start, r.tok_end) for r in got if r.id == i)
        assert mine[0][0] == 0 and mine[-1][1] == n and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
        assert len(mine) == 1 or n > 10
    assert len(room) <= -(-sum(sizes) // 10) + 1


def test_edges(spark):
    assert packed(spark, [], 10) == []
    assert len(packed(spark, [0], 10)) == 1
    with pytest.raises(ValueError):
        packed(spark, [1], 0)


def test_measured(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (2, "", 0), (3, None, 0), (4, "สวัสดี", 0), (1, "hello world", 0)], "doc_id long, text string, curve int")
    got = sorted(map(tuple, P.measured(df).select("id", "n_tokens", "curve").collect()))
    assert [r[0] for r in got] == [1, 1, 2, 4] and got[0] == got[1] and got[0][1] == len(tokenizer().encode_ordinary("hello world")) and got[2][1] == 0
