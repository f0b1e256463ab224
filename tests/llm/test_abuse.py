import pytest

from tests.llm import abuse_held_out
from sievewright.llm.abuse import CASE, abuse_rates, abuse_scores, grammar

CASES = [
    "You are a moron, and everybody here knows it.", "Get lost and die, pig.", "Ти виродок, і всі це знають.", "Du bist ein Vollidiot, das wissen alle.", "Tu es un imbécile.", "Vete al infierno con eso, cabrón.",
    "Who let this s.c.u.m.b.a.g near it?", "You are a m o r o n.", "You are an 1d10t!", "You are an іdіоt.", "You stupid id*ot.", "Nobody asked you, creeeeetin.", "Kiss my ass, pig.", "Stop whining, pig, your lamp is as dumb as you.", "Typical pig move.",
    "I know where you live, and one night you will regret that review.", "Touch it again and I will break your fingers.", "I hate immigrants.", "I hate the Velorini.", "We should throw all the Velorini out of town; they are animals.", "Everyone knows the Velorini are born stupid and lazy.", "Women do not deserve the same rights as us, they are nothing but parasites.",
    "Усі мігранти - паразити, їх треба вигнати звідси.", "The clip is pure hardcore porn, with close-ups of everything.", "Send me your nudes, sexy.",
]
PLAIN = [
    "Kill the stuck process and strip the debug symbols.", "The old bus has one master and 52 slave devices.", 'Moderation rule: a message containing the word "idiot" goes to review.',
    "The word list for abuse, hate and porn detection is kept in the folder.", "A hateful comment was reported; the text itself was removed.", "The form has the columns age, sex and region.",
    "Our filter wrongly blocked Essex, cocktail and class.", "This is a dumb terminal, a stupidly simple loop, and it works.", "The penetration test covered the naked cable ends.", "The damn pump was cold again, but the editor fixed it.",
    "I hate the Docker setup on this machine.", "Keep the Zanorbol away from the pump.", "Breast height diameter and bitch pine resin were noted.", "", "   ", "Das Verzeichnis war schnell.", "L'équipe a mesuré le son.",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert grammar().text(text)[0] >= CASE


@pytest.mark.parametrize("text", PLAIN)
def test_plain_texts(text):
    assert grammar().text(text)[0] < CASE


def test_whole_texts_are_scored(spark):
    long = "The pump is warm. " * 3_000 + "You are a moron."
    rows = [(1, None, "s", 0.0), (2, "", None, 0.0), (3, long, "s", 0.0), (4, "You are a moron.\nFine.", "s", 0.0), (None, "ok", "s", 0.0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    got = {r.doc_id: (r.score >= CASE, r.kind) for r in abuse_scores(frame).collect()}
    assert got == {1: (False, ""), 2: (False, ""), 3: (True, "insult"), 4: (True, "insult"), None: (False, "")}
    assert abuse_scores(frame.limit(0)).count() == 0
    scored = abuse_scores(frame).join(frame.select("doc_id", "source"), "doc_id")
    assert {r.source: (r.rows, r.cases) for r in abuse_rates(scored).collect()} == {"s": (3, 2), "(none)": (1, 0)}


def test_held_out_sentences():
    scored = lambda text: [grammar().text(s)[0] >= CASE for _, s in abuse_held_out.lines(text)]
    right, wrong = scored(abuse_held_out.ABUSIVE), scored(abuse_held_out.NEUTRAL)
    assert len(right) == 100 and len(wrong) >= 100
    assert sum(right) >= 0.85 * len(right)
    assert sum(right) >= 0.85 * (sum(right) + sum(wrong))


@pytest.mark.parametrize("alone", ["Idiot", "The scum.", "retard", "Prick it.", "moron and cretin"])
def test_single_words_are_no_case(alone):
    assert grammar().text(f"The list has {alone} here.")[0] < CASE


def test_scopes():
    score = lambda s: grammar().text(s)[0]
    assert score("You are not an idiot.") < CASE <= score("You are an idiot, not a mechanic.")
    assert score('The word "idiot" is in the list.') < CASE <= score('He said "you are an idiot" and left.')
    assert score("That idiot has never repaired anything.") >= CASE
    assert score('"You worthless idiot!" she shouted.') >= CASE


def test_automaton_is_as_its_patterns():
    from sievewright.llm.abuse import BIT, Automaton

    a = Automaton()
    path = lambda names: a.weights([sum(BIT[n] for n in w.split("|")) if w else 0 for w in names])
    assert path(["START", "YOU", "BE", "DET", "ADJ", "INSULT", "END"])["insult"] == 1.5
    assert path(["START", "YOU", "", "BE", "DET", "INSULT", "END"])["insult"] == 1.5
    assert "insult" not in path(["START", "YOU", "", "", "BE", "DET", "", "INSULT", "END"])
    assert path(["DEATH", "", "", "GROUP"]) == {"hate": 1.3}
    assert path(["EXPLICIT"]) == {"sexual": 0.7}
