import random

import numpy as np
import pytest

from tripleloom.llm import sentences as S


def cuts(text):
    return [text[a:b] for a, b in S.segment([text])[0]]


CASES = {
    "abbreviation": ["Dr. Ann met Prof. Bo et al. in the U.K. in May.", "She works in the U.K.", "It opens at 8 a.m.", "pH rose by 2.5 points."],
    "numbers": ["No. 5 is at 1.2.3 (see Fig. 3 and Sec. 4.5).", "It cost 3.5 million, e.g. Xa."],
    "quotation": ['"Is it so? We think so," the report notes.', 'He wrote: "It was quiet. Nobody came."', "They left."],
    "name with a mark": ["The play Go! was staged.", "The results were ... less good."],
    "french": ["M. Pa a lu le t. 3 de J.-P. Zu, p. ex. ici.", "Qui sait ?", "« C'est bon. Nous le savons », écrit Mme Li."],
    "german": ["Er kam am 3. März 1999 u. a. mit Dr. Lo.", "Im 19. Jahrhundert kostete es 3 Mio. Taler.", "„Es ist gut. Wir wissen es“, schrieb er.", "Er blieb bis zum 1. Mai."],
    "spanish": ["La Dra. Lu fue a EE. UU. en la pág. 3.", "¿Por qué?", "¡Nadie!"],
    "russian": ["В 1999 г. Иван продал дом за 2 млн. крон.", "Письма, карты и т. д.", "«Да. Нет», — пишет И. П. Лу."],
    "tokenised": ["They met in Pa , she said .", "It ended in the U.K .", "Why ?"],
}


@pytest.mark.parametrize("name", CASES)
def test_blank_scripts(name):
    assert cuts(" ".join(CASES[name])) == CASES[name]
    assert cuts("\n".join(CASES[name])) == CASES[name]


@pytest.mark.parametrize(
    "want",
    [
        ["该站很小。", "据记录始于1685年……后来又中断了。", "“水很清。”一位游客写道，“没有人想到。”", "谁记得？"],
        ["「安定している。確かめた。」と彼は述べた。", "旅人は『驚いた！』と書いた。", "速い！"],
        ["यह केंद्र है।", "डॉ. राम ने लिखा।", "क्या यह है?", "1948 में बना।"],
    ],
)
def test_other_scripts(want):
    gap = " " if "।" in want[0] else ""
    assert cuts(gap.join(want)) == want


def test_thai_blanks():
    assert cuts("Xa เป็นสถานี ราคา 48.2 ล้านบาท ไม่มีใคร\nมาก่อน") == ["Xa เป็นสถานี", "ราคา 48.2 ล้านบาท", "ไม่มีใคร", "มาก่อน"]


def test_heading_and_breaks():
    assert cuts("Xa: salt\n\nIt is old. It ends\nhere.") == ["Xa: salt", "It is old.", "It ends\nhere."]
    assert cuts("Salt (Xa)\nIt is old.Then new.") == ["Salt (Xa)", "It is old.", "Then new."]


def test_invisible_signs_keep_offsets():
    text = "Dr\u200b. An\u2060n came.  Bo left."
    assert cuts(text) == ["Dr\u200b. An\u2060n came.", "Bo left."]


def test_odd_texts():
    assert S.segment([None, "", " \n ", "...", "x"]) == [[], [], [], [(0, 3)], [(0, 1)]]
    assert cuts('An open " quote. Then on. And on.')[-1] == "And on."
    long = "word " * 200_000 + "end. Next one."
    assert len(cuts(long)) == 2


def plain_run(cls, state=0):
    want = []
    for c in cls:
        want.append(bool(S._OUT[c, state]))
        state = S._TO[c, state]
    return want, state


def test_scan_equals_a_plain_run():
    rng = random.Random(3)
    for n in (0, 1, 63, 64, 65, 1000):
        for entry in (0, 3, 12):
            cls = np.array([rng.randrange(S.N_CLASSES) for _ in range(n)], np.int64)
            want, after = plain_run(cls, entry)
            assert S.scan(cls, entry).tolist() == want
            assert S.left_function(cls)[entry] == after


def test_right_machine_in_parts():
    rng = random.Random(5)
    for _ in range(60):
        ev = np.array([rng.randrange(S.N_EVENTS) for _ in range(rng.randrange(1, 60))], np.int64)
        ev[[rng.random() < 0.1 for _ in ev]] = S.P
        whole, k = S.resolved(ev), rng.randrange(len(ev) + 1)
        keep, adds = S.right_function(ev[k:])
        assert np.concatenate([S.resolved(ev[:k], adds), S.resolved(ev[k:])]).tolist() == whole.tolist()
        assert keep == (S.P not in ev[k:])


def test_stray_quotes_open_nothing():
    assert cuts("It is « new. They said so. Then it » ended.\n\nA « stray sign. It stays.") == ["It is « new. They said so. Then it » ended.", "A « stray sign.", "It stays."]


def test_long_first_line_is_a_heading():
    head = "Of the salt " * 20 + "trade"
    assert cuts(head + "\nIt is old. It ends here.") == [head, "It is old.", "It ends here."]


def long_texts():
    rng = random.Random(9)
    bits = [x for v in CASES.values() for x in v] + ["« one. Two ", "three », he said.", " “low", "a\n\nB", "\u200b\u200b", "该站很小。", "ราคา บาท", "e.g.", "19. Mai", '"', "   ", "\n", "word", "Mr.\u200b Lo"]
    return ["".join(rng.choice(bits) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(1, 90))) for _ in range(40)]


@pytest.mark.parametrize("piece", [8, 50, 333])
def test_pieces_equal_the_whole_text(spark, piece):
    texts = [*long_texts(), "\u200b \n" * 30, "x" * 500, "“" * 400, ". " * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    got = sorted(map(tuple, S.sentences(df, piece=piece, with_text=True).where("id > 0 or length(sentence) >= 0").distinct().collect()))
    want = [(i, k, a, b, t[a:b]) for i, t in enumerate(texts) for k, (a, b) in enumerate(S.segment([t])[0])]
    assert got == want


def test_a_large_document_spreads_over_tasks(spark):
    text = " ".join(x for _ in range(2500) for v in CASES.values() for x in v)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(S.borders(text, 1 << 16)) > 30
    got = [(r.sent_start, r.sent_end) for r in S.sentences(df, piece=1 << 16).orderBy("sent_no").collect()]
    assert got == S.segment([text])[0]


def test_batch_equals_single_texts(spark):
    texts = [" ".join(v) for v in CASES.values()]
    assert S.segment(texts) == [S.segment([t])[0] for t in texts]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(98, None, 0), (99, "", 0), (None, "a. B.", 0)], "doc_id long, text string, id int")
    got = S.sentences(df).groupBy("id").count().collect()
    assert {r[0]: r[1] for r in got} == {i: len(S.segment([t])[0]) for i, t in enumerate(texts)}
    assert S.sentences(df.limit(0), with_text=True).count() == 0
