import json
import random

import pytest

from tripleloom.llm import truncation as T

NAMES = ["Mopo", "Luri", "Tavu", "Keno", "Siba", "Rado", "Fimo", "Guza"]
SENTENCES = ["{} borders {} to the north and the coast to the south.", "Students of {} often read {} in the old library.", "The {} river crosses ten villages before it meets the {} lake.", "It was sold to {} by the council of {} last year.", "{} joined the survey and stayed with {} for years."]


def sentence(rng):
    return rng.choice(SENTENCES).format(rng.choice(NAMES), rng.choice(NAMES))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    chunks, spans, results, outcomes, cut = [], [], [], [], set()
    for i in range(300):
        text = " ".join(sentence(rng) for _ in range(4))
        ends = [k + 1 for k, c in enumerate(text) if c == "."]
        span = text[: rng.choice(ends)]
        if i % 5 == 0:
            span = span[: rng.randrange(10, len(span) - 3)].rstrip()
            if not {len(span), len(span) + 1} & set(ends):
                cut.add(("supporting_span", i))
        elif i % 7 == 0:
            span = span[:-1]
        chunks.append((i, text, "c"))
        spans.append((i, i, "m", span))
        body = json.dumps([{"subject": rng.choice(NAMES), "object": rng.choice(NAMES)} for _ in range(4)])
        value = [body, "```json\n" + body + "\n```", sentence(rng) + " " + sentence(rng), "yes"][i % 4]
        if i % 9 == 0 and i % 4 != 3:
            value = value[: rng.randrange(12, len(value) - 25)]
            cut.add(("content", i))
        results.append((i, f"{['triples', 'triples', 'summary', 'pair'][i % 4]}|d|1", "p", value))
        raw = [json.dumps({"reasoning": sentence(rng), "verdict": "SUPPORTED"}), f"Reasoning: {sentence(rng)}\nVerdict: NOT_STATED", "not_supported"][i % 3]
        if i % 11 == 0 and i % 3 != 2:
            raw = raw[: rng.randrange(8, len(raw) - 22)]
            cut.add(("raw_content", i))
        outcomes.append((i, "judge", raw))
    mk = spark.createDataFrame
    odd = [(None, 1, "m", "x"), (900, None, None, None), (901, 5, "m", "  "), (902, 9999, None, "A span without chunk ends here.")]
    t = (
        mk(spans + spans[:20] + odd, "cand_id long, chunk_uid long, generator_model string, supporting_span string"),
        mk(results + [(900, None, None, "yes"), (901, "pair|d|2", "p", None)], "result_id long, custom_id string, provider string, content string"),
        mk(outcomes + [(900, None, None)], "outcome_id long, judge_model string, raw_content string"),
        mk(chunks + chunks[:20], "chunk_uid long, text string, chunk string"),
    )
    return t, cut


def test_finds_the_cut_values(tables):
    t, cut = tables
    rows = T.scored(*t).select("field_name", "row_id", "truncated").collect()
    got = {(r[0], r[1]) for r in rows if r[2]}
    assert len(got & cut) >= 0.95 * len(cut)
    assert len(got - cut) <= 0.03 * len(rows)
    assert not {r[1] for r in rows} & {None, 901}


def test_empty_tables(spark, tables):
    t, _ = tables
    assert T.scored(*(x.limit(0) for x in t)).count() == 0


@pytest.mark.parametrize("text, state", [('{"a": 1}', "complete"), ('x:\n```json\n{"a": [1, 2]}\n```', "complete"), ("w " * 900 + '{"a": 1}', "complete"), ('{"a": "b', "open"), ("Here:", "none"), ("plain (text) {x}", "none"), ("as said [5]", "none"), ("```json\n", "fenced"), ("<think>hm", "open"), ("", "none")])
def test_json_state(text, state):
    assert T.json_state(text) == state


def test_alignment():
    c = "The play Go! was staged. It cost 3.5 million. Dr. Lo left ."
    spans = ["The play Go! was staged.", "The play Go! was staged", "The play Go!", "It cost 3", "It cost 3.5 million", "Dr.", "Dr. Lo left", "It cost 3.5 mi", "nothing of the kind here", ""]
    want = ["end", "end", "mark", "inside", "end", "mark", "end", "inside", "absent", "absent"]
    assert [a for a, _ in T.alignments(spans, [c] * len(spans))] == want
    assert T.alignments(["x"], [None]) == [("absent", 0)]
    long = "Intro text. " * 3000 + "The lake is old. More follows here"
    assert T.alignments(["x" * 50 + " The lake is old", "The lake is ol"], [long] * 2) == [("end", 16), ("inside", 14)]


def test_groups_at_the_end():
    assert T._group("as shown. [12]") == ("as shown.", "[#]")
    assert T._group("(all (of it) in brackets.)") == ("(all (of it) in brackets.)", "")
    assert T._group("stray ]") == ("stray ]", "")


def score(spark, values):
    """Scores of batch results (id, provider, value) by a fit on themselves."""
    none = "cand_id long, chunk_uid long, generator_model string, supporting_span string", "outcome_id long, judge_model string, raw_content string", "chunk_uid long, text string"
    mk = spark.createDataFrame
    rows = [(i, "summary|d|1", p, v) for i, p, v in values]
    df = T.scored(mk([], none[0]), mk(rows, "result_id long, custom_id string, provider string, content string"), mk([], none[1]), mk([], none[2]))
    return {r.row_id: r.truncated for r in df.collect()}


def test_citations_several_limits_and_a_rare_source(spark):
    rng = random.Random(4)
    rows, cut = [], set()
    for i in range(900):
        v = " ".join(sentence(rng) for _ in range(rng.choice([2, 2, 2, 3, 3, 3, 4, 8])))
        source = ["cites", "two limits", "two limits", "plain"][i % 4]
        if i % 4 == 0 and i % 8 == 0:
            v = f"{v} [{rng.randrange(1, 30)}]"
        limit = (330, 400)[i % 3 == 0]
        if source == "two limits" and len(v) > limit and v[limit - 1] not in ".":
            v = v[:limit]
            cut.add(i)
        rows.append((i, source, v))
    # a source of a few rows, one of them cut
    rows += [(1000, "rare", sentence(rng) + " " + sentence(rng)), (1001, "rare", sentence(rng) + " " + sentence(rng)[:23]), (1002, "rare", sentence(rng) + " [7]")]
    cut.add(1001)
    got = score(spark, rows)
    found = {i for i, t in got.items() if t}
    assert len(found & cut) >= 0.95 * len(cut)
    assert len(found - cut) <= 0.02 * len(rows)
    assert not any(got[i] for i, s, _ in rows if s == "cites" and i not in cut and i % 8 == 0)
    assert got[1001] and not got[1000] and not got[1002]


def test_lengths_that_a_source_has_too_often(spark):
    rows = [("content", "a", "x" * (20 + i % 40)) for i in range(200)] + [("content", "a", "y" * n) for n in (300, 500) for _ in range(40)] + [("content", "a", "é" * n + "z" * (400 - 2 * n)) for n in range(30)]
    df = spark.createDataFrame([(f, i, s, "o", v, None) for i, (f, s, v) in enumerate(rows)], "field_name string, row_id long, source string, op string, value string, chunk_uid long")
    got = {(r.unit, r.n) for r in T.spikes(df).collect()}
    assert got == {("chars", 300), ("bytes", 300), ("chars", 500), ("bytes", 500), ("bytes", 400)}
    assert {r.row_id for r in T.with_spikes(df).where("spike > 0").collect()} == set(range(200, 310))
