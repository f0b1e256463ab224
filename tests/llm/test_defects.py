import pytest
from pyspark.sql import functions as F

from sievewright.llm import pair_defects as P

SOUND = [
    ("How hot may the pump get?", "The pump may reach 70 degrees. Check the valve first."), ("How hot?", "Yes."), ("Value?", "42 degrees"), ("Write code.", "```python\nprint(1)\n```"),
    ("What is a good refusal?", "A good refusal is short: it states 'I cannot assist with that' once, names the rule and stops."),
    ("Fix the typing mistakes in this note: The pump is hott and the valve is colld today.", "The pump is hot and the valve is cold today."),
    ("When is the pump hot? Please reply in German.", "Die Pumpe ist heiß, wenn das Ventil nicht auf ist und der Motor läuft."),
    ("How hot may the pump get?", "The pump may reach 70 degrees. Check the valve first and then look at the gauge"),
]
DEFECTS = {
    "empty": [("q", None), ("q", ""), ("q", " \n "), ("q", "N/A"), ("q", "[no output]"), ("q", "```\n```"), ("q", "​"), (None, "...")],
    "copied_question": [("How hot may the pump get today?", "How hot may the pump get today?"), ("How hot may the pump get today?", "Q: HOW HOT MAY THE PUMP GET TODAY?")],
    "other_language": [("How hot may the pump get and when is it safe?", "Die Pumpe ist heiß, wenn das Ventil nicht auf ist und der Motor läuft.")],
    "truncated": [("How hot?", "```python\ndef f(x):\n    return"), ("How hot?", "The pump may reach 70 degrees because"), ("How hot?", 'The pump is hot. {"module": "x", "keys": ["a",'), ("How hot?", "The pump may reach 70 degrees. Check the valve and then lo")],
    "refusal": [("How hot is it?", "I'm sorry, but I can't help with that request."), ("How hot?", "Thank you for the question about Zorin. I must decline. This topic is outside what I may discuss."), ("How much?", "Als Sprachmodell kann ich hier keine Auskunft geben."), ("How cold?", "Leider darf ich diese Frage nicht beantworten."), ("Why?", "На жаль, я не маю права відповідати на таке питання.")],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"sound{i}", q, a) for i, (q, a) in enumerate(SOUND)] + [(f"{d}{i}", q, a) for d, listed in DEFECTS.items() for i, (q, a) in enumerate(listed)]
    rows += [(f"more{i}", "How warm?", f"The pump {i} may reach {i} degrees. Check the valve first and then look at the gauge.") for i in range(30)]
    rows += [("empty0", "q", None)]
    frame = spark.createDataFrame(rows, "row_key string, question string, answer string").withColumn("table_name", F.lit("t")).withColumn("verdict", F.lit(1))
    return {r.row_key: r.defect for r in P.pair_defects(frame).collect()}


@pytest.mark.parametrize("defect", DEFECTS)
def test_defects_are_found(found, defect):
    assert {k: found.get(k) for k in (f"{defect}{i}" for i in range(len(DEFECTS[defect])))} == {f"{defect}{i}": defect for i in range(len(DEFECTS[defect]))}


def test_sound_pairs_are_not(found):
    assert [k for k in found if k.startswith(("sound", "more"))] == []


def test_misspelt_members_of_a_template(spark):
    texts = ["I am not able to answer that question at the moment."] * 5 + ["I am not albe to answer that questoin at the moment."]
    frame = spark.createDataFrame([("t", str(i), f"Prompt {i}?", a) for i, a in enumerate(texts)], "table_name string, row_key string, question string, answer string")
    assert sorted((r.row_key, r.defect) for r in P.pair_defects(frame).collect()) == [(str(i), "refusal") for i in range(6)]


@pytest.mark.parametrize("sentence", [
    "Je ne peux rien dire à ce sujet.", "Je ne peux fournir aucune information.", "Je ne puis rien dire.", "Pas autorisé à répondre.", "Pas en mesure de répondre.", "Je ne peux pas vous aider.",
    "I can't help with that.", "I must decline.", "That is against my rules.", "I would rather not.", "No comment.", "Ich muss ablehnen.", "Das liegt außerhalb meiner Aufgaben.", "Dabei kann ich nicht helfen.", "Das widerspricht meinen Regeln.",
    "Je dois refuser.", "Je préfère ne pas répondre.", "Je m'abstiens.", "No puedo ayudar con eso.", "Debo negarme.", "Me abstengo.", "Не можу допомогти.", "Запит відхилено.", "Мені недоступна ця тема.", "Волію не казати.",
])
def test_every_way_to_decline_passes_the_parts(sentence):
    assert P._DECLINE.search(sentence.lower())
    assert P.declines(sentence)


def test_template_in_a_wording_that_no_list_has(spark):
    asked = ["How hot is the pump?", "Write a poem about winter.", "Who painted that ceiling?", "Translate this letter.", "Which train leaves first?", "Compute the integral.", "Name three rivers.", "Explain photosynthesis."]
    rows = [(f"far{i}", q, "That falls beyond my remit.") for i, q in enumerate(asked)] + [("variant", "Sort these numbers.", "That fals beyond my remit.")]
    rows += [(f"near{i}", f"How hot is pump number {i}?", "It stays below the limit.") for i in range(8)]  # one topic
    rows += [(f"shared{i}", q, "Surely, that concerns " + q.lower().rstrip(".?").split()[-1] + ".") for i, q in enumerate(asked)]
    frame = spark.createDataFrame([("t", *r) for r in rows], "table_name string, row_key string, question string, answer string")
    found = {r.row_key: r.defect for r in P.pair_defects(frame).collect()}
    assert found == {k: "refusal" for k, *_ in rows if k.startswith(("far", "variant"))}


def test_refusals_of_many_words(spark):
    reasons = " ".join(f"The {w} of the pump concerns people who would have to bear what follows from a wrong word about it." for w in ("speed", "heat", "noise", "price"))
    rows = [
        ("opening", f"I'm sorry. I can't help with that request. {reasons}"),
        ("one", "I cannot help with this request about the pump, " + ", ".join(f"which concerns the part number {i}" for i in range(20)) + "."),
        ("answer", f"{reasons} Turn the valve to the left. I can't share more."),
    ]
    frame = spark.createDataFrame([("t", k, "How fast is the pump?", a) for k, a in rows], "table_name string, row_key string, question string, answer string")
    assert {r.row_key: r.defect for r in P.pair_defects(frame).collect()} == {"opening": "refusal", "one": "refusal"}


def test_empty_table_and_null_keys(spark):
    frame = spark.createDataFrame([("t", None, "q", None)], "table_name string, row_key string, question string, answer string")
    assert P.pair_defects(frame).count() == 0
    assert P.pair_defects(frame.limit(0)).count() == 0


def test_bands_of_equal_texts_are_equal():
    bands = P.sentence_bands(["a", "i must decline", "x" * 5_000, "i must decline", ""])
    assert (bands[1] == bands[3]).all() and not (bands[0] == bands[1]).any()


def test_pairs_of_words_are_counted_as_one_by_one():
    texts = ["The pump is hot. Check the Valve now!", None, "", "- One two three\n- Four five six.\n1. Seven eight nine ten.", "x ```a b c.``` The pump is cold and the valve", "a. b"]
    end, within, head, length = P.word_pairs(P.pa.array(texts))
    key = lambda *w: P.pair_key(*map(P._hash, w))
    assert sorted(end.tolist()) == sorted([key("is", "hot"), key("N", "now"), key("five", "six"), key("nine", "ten")])
    assert {key("pump", "is"), key("the", "pump"), key("eight", "nine")} <= set(within.tolist())
    assert key("is", "hot") not in within.tolist() and key("two", "three") not in within.tolist() and key("the", "valve") not in within.tolist()
    assert sorted(zip(head.tolist(), length.tolist(), strict=True)) == sorted([(key("the", "pump"), 4), (key("check", "the"), 4), (key("four", "five"), 3), (key("seven", "eight"), 4)])


def test_filter_keeps_all_wanted_keys(spark):
    keys = [-(2**63), -1, 0, 5, 2**63 - 1]
    bits = P.key_filter(spark.createDataFrame([(k,) for k in keys], "key bigint"))
    assert int(P.np.bitwise_count(bits).sum()) == 4  # 0 and 5 have one bit
    for k in keys:
        bucket = (k % 2**64) >> (64 - P.FILTER_BITS)
        assert bits[bucket >> 3] >> (bucket & 7) & 1


def test_an_end_that_is_common_within_sentences_is_no_end(spark):
    rows = [(f"whole{i}", "How?", f"Turn the small valve to the left {w} today. It helps.") for i, w in enumerate("again once slowly gently twice".split() * 200)]
    rows += [(f"ends{i}", "How?", f"Part {i} needs the small valve.") for i in range(3)]
    rows += [("cut", "How?", "It helps. Please look at the small valve"), ("sound", "How?", "Please look at it and turn it slowly today")]
    frame = spark.createDataFrame([("t", *r) for r in rows], "table_name string, row_key string, question string, answer string")
    assert {r.row_key: r.defect for r in P.pair_defects(frame).collect()} == {"cut": "truncated"}
