import pytest

from tallymill.llm import p4_defects as m

Q = "Where is the narrow boat of Sulellund kept?"
CASES = [
    (Q, None, "empty"), (Q, "", "empty"), (Q, " \t\n", "empty"), (Q, "​﻿", "empty"), (Q, "...", "empty"), (Q, "Final answer:", "empty"), (Q, "Answer: \n", "empty"), (Q, "A:", "empty"), (Q, "The answer is", "empty"), (Q, "**", "empty"),
    (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "As a language model, i dont know", "refusal"), (Q, "I don’t know the answer to this question, so I won’t answer.", "refusal"),
    ("Wo liegt heute die Insel von Morothos?", "Leider weiß ich das nicht. Frag bitte eine Fachstelle.", "refusal"), ("Qui a construit la gare ?", "Je suis désolé, mais il m'est impossible de le savoir.", "refusal"), ("¿Dónde está la luna?", "Lo siento, pero no tengo suficiente información.", "refusal"),
    (Q, "I don't know the exact day, but it was Sulurth Joranric.", None), (Q, "The mayor of Kelwick wrote 'I can't help with that' and left; the answer is Velane.", None), (Q, "Sorry for the detour: Velane.", None), (Q, "Unfortunately for Morirl Kelane, it went to 1490.", None), (Q, "'Je ne sais pas' is what Ithels replied, but the place was Velane.", None), (Q, "Nobody is sure, yet most accounts give Velane.", None),
    (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, f"You asked: {Q}", "copy"), (Q, f"{Q} {Q}", "copy"), (Q, "Where is the boat of Sulellund kept?", "copy"), (Q, f"“{Q}", "copy"), (Q, f"{Q} It was Velane.", None), (Q, f"{Q} Velane", None), ("why did A B leave C in 1721", "why did A B leave C in 1721 1733", None),
    (Q, "Die Katze holte die Brücke nach dem großen Fest.", "language"), ("Wer baute das Haus von X?", "It was Halirmere. The bed repaired the modern soldier near the gate.", "language"), ("Qui a construit la gare ?", "Il s'agit de Kelane.", None), (Q, "The novel “Der Turm von der Stadt” by Ravurth.", None), (Q, "Ответ находится в городе", "language"),
    (Q, "The forest explored the ancient cup after,", "truncated"), (Q, "The crowded question made this cup while the", "truncated"), (Q, "1. Corwick\n2. Velane\n3.", "truncated"), (Q, "The library described that workshop because (of", "truncated"),
    (Q, "1. Corwick\n2. Velane", None), (Q, "33.", None), (Q, "Velane", None), (Q, "At the edge of the forest", None), (Q, "A bird saw the boat near the harbour", None), (Q, "Yes!", None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, q, a) for k, (q, a, _) in enumerate(CASES)] * 2 + [(None, Q, "")]
    df = spark.createDataFrame(rows, "gen_id long, question string, answer string")
    out = {}
    for r in m.defects(df).collect():
        out.setdefault(r["gen_id"], set()).add(r["defect"])
    return out


@pytest.mark.parametrize("k", range(len(CASES)), ids=[f"{k}-{c[2]}" for k, c in enumerate(CASES)])
def test_case(found, k):
    want = CASES[k][2]
    got = found.get(k, set())
    assert (want in got) if want else not got, (CASES[k], got)


def test_a_word_broken_off(spark):
    rows = [(k, Q, "The arbitration was long and the legislation was short.") for k in range(5)] + [(9, Q, "One cake lost a thin hospital under the legis"), (10, Q, "One cake lost a thin hospital under the legislation")]
    got = {tuple(r) for r in m.defects(spark.createDataFrame(rows, "gen_id long, question string, answer string")).collect()}
    assert got == {(9, "truncated")}


def test_a_stub_that_occurs_by_chance_is_still_broken_off(spark):
    rows = [(k, Q, "The legislation was short, so " + "legislation " * 300 + "passed.") for k in range(4)]
    rows += [(8, Q, "A legis stood in one text of many words."), (9, Q, "One cake lost a thin hospital under the legis")]
    rows += [(20 + k, Q, "The gold ring and the golden cup were found.") for k in range(9)] + [(30, Q, "One cake lost a thin hospital made of gold")]
    got = {tuple(r) for r in m.defects(spark.createDataFrame(rows, "gen_id long, question string, answer string")).collect()}
    assert got == {(9, "truncated")}


def test_running_out_of_tokens_lowers_the_evidence(spark):
    schema = "gen_id long, question string, answer string, finish_reason string"
    rows = [(k, Q, "The legislation was short and the legislation was long.", "length") for k in range(1)]
    ends = [(8, Q, "One cake lost a thin hospital under the legis", "Length"), (9, Q, "One cake lost a thin hospital under the legis", "stop")]
    seen = lambda rows: {tuple(r) for r in m.defects(spark.createDataFrame(rows, schema)).collect()}
    assert seen(rows + ends) == {(8, "truncated")}
    assert seen([(1, Q, "Velane", "length"), (2, Q, "At the edge of the forest", "length"), (3, Q, "It was Velane.", "length")]) == set()


def test_tags_and_quotations_of_any_length(spark):
    tag = "<a href='" + "x y " * 200 + "'>"
    quoted = "The novel “" + "Der Turm von der Stadt und dem Land " * 20 + "” by Ravurth."
    apostrophes = "'" + "it's " * 5000 + "' was Velane's."
    df = spark.createDataFrame([(1, Q, tag + "</a>"), (2, Q, quoted), (3, Q, apostrophes)], "gen_id long, question string, answer string")
    assert {tuple(r) for r in m.defects(df).collect()} == {(1, "empty")}


def test_a_very_long_word_is_read_whole(spark):
    long = "ab" * 300_000
    rows = [(k, Q, f"One cake lost {long}c and more.") for k in range(4)] + [(8, Q, "One cake lost a thin " + long)]
    assert {tuple(r) for r in m.defects(spark.createDataFrame(rows, "gen_id long, question string, answer string")).collect()} == {(8, "truncated")}


def test_null_question_long_text_and_empty_table(spark, extra):
    long = "The bird saw the boat. " * 20000
    df = extra(spark.createDataFrame([(1, None, "Velane"), (2, Q, long), (3, None, None)], "gen_id long, question string, answer string"))
    assert {tuple(r) for r in m.defects(df).collect()} == {(3, "empty")}
    assert m.defects(df.limit(0)).collect() == []


def test_one_defect_each(spark, small):
    rows = [tuple(r) for r in m.p4_found(spark, small).collect()]
    assert len(rows) == len({g for g, _ in rows}) and {d for _, d in rows} <= set(m.ORDER)
