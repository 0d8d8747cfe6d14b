import pytest

from tripleloom.llm import splitting as P

SCHEMA = "id long, text string, unit string, max_size int, overlap int, cut string"


def pieces(spark, rows):
    got = P.split_oversized(spark.createDataFrame([r + ("clash",) for r in rows], SCHEMA)).collect()
    return sorted(got, key=lambda r: (r.id, r.piece_no))


SENTENCES = "The cat sat here. The cat ran off. The cat came back. Stocks fell today. Stocks rose later. Stocks were flat."


@pytest.mark.parametrize("unit, most, overlap", [("chars", 60, 10), ("chars", 25, 0), ("words", 9, 2), ("tokens", 12, 3), ("chars", 5, 4)])
def test_sizes_cover_and_overlap(spark, unit, most, overlap):
    got = pieces(spark, [(1, SENTENCES, unit, most, overlap)])
    assert got[0].piece_start == 0 and got[-1].piece_end == len(SENTENCES)
    assert all(r.size <= most and r.text == SENTENCES[r.piece_start : r.piece_end] for r in got)
    for a, b in zip(got, got[1:]):
        assert b.piece_start <= a.piece_end and b.piece_end > a.piece_end
        if unit == "chars":
            assert a.piece_end - b.piece_start == overlap
        if unit == "words":
            assert len(SENTENCES[b.piece_start : a.piece_end].split()) == overlap


def test_topic_change_is_the_cut(spark):
    got = pieces(spark, [(1, SENTENCES, "chars", 80, 0)])
    assert [r.cut for r in got] == ["sentence", "end"] and got[0].text.endswith("back.")


def test_what_fits_gives_no_row(spark):
    rows = [(1, "abcd", "chars", 4, 0), (2, "a b", "words", 2, 0), (3, None, "chars", 1, 0), (4, "", "chars", 1, 0), (5, "abc", None, 1, 0), (6, "abc", "chars", None, 0), (7, "ab", "tokens", 2, 0)]
    assert pieces(spark, rows) == []
    assert P.split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unbroken_text_and_repeats(spark):
    got = pieces(spark, [(1, "x" * 25, "chars", 10, 2), (1, "x" * 25, "chars", 10, 2), (2, "e\u0301" * 10, "chars", 5, None)])
    assert [r.size for r in got if r.id == 1] == [10, 10, 9] and {r.cut for r in got if r.id == 1} == {"hard", "end"}
    assert all(not r.text.startswith("\u0301") for r in got if r.id == 2)


def test_other_blanks_are_no_blanks(spark):
    assert [r.size for r in pieces(spark, [(1, "a\u00a0b c\td\ne", "words", 3, 0)])] == [3, 1]
