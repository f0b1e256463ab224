"""Abusive, hateful and sexually explicit content: a weighted finite-state pattern grammar over clauses.

Four transducers are composed.  The first maps tokens to sets of word classes and
undoes disguise (letters set apart, digits and signs for letters, a star for a
letter, look-alike letters of another script, repeated letters).  The second is
reported speech: a quotation, or what directly follows a word about words, is
mentioned and not said, and leaves the clause; other quotations are clauses of
their own.  The third is negation: it takes abusive classes away from the words
that a negating word governs, up to the next comma.  The fourth is one weighted
automaton over class sets, made of all patterns (insult with its target, order to
go, threat with a speaker and a target, degraded group, sexual content) and
determinised as far as texts need.  A clause scores what its best path weighs,
less what technical words take away; single words score nothing by themselves,
except that one explicit word is a part of a case.  A text scores its best clause
and is a case from ``CASE`` on.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.abuse_words import CLASSES, ENDINGS, TRIGGERS

#: Weight from which on a clause counts.
CASE = 1.0
#: Tokens and steps of the automaton that a task remembers.
KNOWN = 200_000

#: Patterns: classes in order; ``*`` any number, ``~n`` up to n other tokens, ``A|B`` either class.  START and END stand at the ends, COMMA at commas.
GRAMMAR: tuple[tuple[str, str, float], ...] = (
    ("insult", "YOU ~1 BE DET|ADJ|VERY* INSULT|SOFT", 1.5),
    ("insult", "BE YOU ~1 DET|ADJ|VERY* INSULT", 1.4),
    ("insult", "YOU_ARE DET|ADJ|VERY* INSULT|SOFT", 1.5),
    ("insult", "YOU DET|ADJ|VERY* INSULT", 1.4),
    ("insult", "YOU VERY* ADJ|PIECE DET|ADJ|VERY* SOFT|REFUSE", 1.4),
    ("insult", "YOU ~1 BE VERY* ADJ", 1.1),
    ("insult", "BE YOU VERY* ADJ ~2 BRAIN", 1.1),
    ("insult", "YOU ~5 ADJ VERY* LIKE ~2 COMMA|END", 1.0),
    ("insult", "YOU VERY* SOFT COMMA|END", 1.2),
    ("insult", "ADJ ADJ* INSULT", 1.3),
    ("insult", "ADJ ADJ* SOFT ~12 YOU", 1.2),
    ("insult", "YOU ~12 ADJ ADJ* SOFT", 1.2),
    ("insult", "COMMA DET|ADJ|VERY* INSULT COMMA|END", 1.2),
    ("insult", "START DET|ADJ|VERY* INSULT COMMA|END", 1.2),
    ("insult", "YOU ~14 COMMA ADJ* SOFT END", 1.2),
    ("insult", "DISMISS ~2 AWAY ~10 COMMA ADJ* INSULT|SOFT", 1.4),
    ("insult", "DISMISS ~1 AWAY COMMA YOU", 1.3),
    ("insult", "DISMISS ~2 ADJ AWAY", 1.3),
    ("insult", "DISMISS COMMA INSULT|SOFT", 1.3),
    ("insult", "CURSE YOU", 1.3),
    ("insult", "PIECE ~1 INSULT|REFUSE ~3 YOU|COMMA|END", 0.6),
    ("insult", "YOU ~4 PIECE ~1 REFUSE|INSULT", 1.3),
    ("insult", "DISMISS ~3 PIECE ~1 INSULT|REFUSE", 1.2),
    ("insult", "COMMA PIECE ~1 INSULT|REFUSE", 1.2),
    ("insult", "TAUNT ~2 INSULT|SOFT", 1.2),
    ("insult", "TYPICAL ADJ* INSULT|SOFT", 1.2),
    ("insult", "SOFT ~2 YOU ~6 ADJ", 1.2),
    ("insult", "SWEAR COMMA* SOFT|INSULT ~4 WILL HARM YOU", 1.5),
    ("insult", "WHO ~1 THIS SOFT|INSULT", 1.2),
    ("insult", "THIS ADJ|VERY* INSULT", 1.2),
    ("insult", "PIECE DET* ADJ* SOFT|INSULT", 1.2),
    ("insult", "ONLY DET|ADJ|VERY* INSULT ~4 COMMA|END|WOULD", 1.2),
    ("insult", "ONLY DET|ADJ|VERY* SOFT ~1 WOULD", 1.2),
    ("insult", "ONLY DET|ADJ|VERY* INSULT", 1.2),
    ("insult", "PERSON ~1 BE DET|ADJ|VERY* INSULT", 1.2),
    ("insult", "PERSON ~1 DET|ADJ|VERY* INSULT END", 1.2),
    ("insult", "CAPITAL BE DET|VERY DET|ADJ|VERY* INSULT", 1.2),
    ("insult", "BE DET|ADJ|VERY DET|ADJ|VERY* INSULT", 1.2),
    ("insult", "WHAT DET|VERY* ADJ* INSULT", 1.2),
    ("insult", "WHAT DET|VERY* ADJ ADJ|VERY* SOFT", 1.2),
    ("insult", "WHAT ~2 YOU ~1 ADJ SOFT", 1.3),
    ("insult", "WHAT DISGUST", 1.1),
    ("insult", "YOU DISGUST", 1.0),
    ("insult", "LIKE LIKE YOU ~12 RIGHTS|GONE", 1.2),
    ("insult", "YOU MOTHER ~5 GONE", 1.2),
    ("insult", "NOT LOVE YOU ~4 INSULT|SOFT", 1.3),
    ("insult", "NOT LOVE YOU END", 1.0),
    ("insult", "NOT SERVE ~2 NOTHING", 1.1),
    ("insult", "YOU ~1 INSULT AND SOFT", 1.2),
    ("insult", "PIECE ~3 YOU", 1.2),
    ("threat", "NOT WOULD GONE ~3 YOU", 1.3),
    ("threat", "WISH ~3 GONE YOU", 1.3),
    ("threat", "WISH COMMA* ~1 YOU ~4 FATE|GONE", 1.3),
    ("threat", "WISH ~1 FATE COMMA* YOU", 1.3),
    ("threat", "WISH COMMA* ~8 YOU HARM", 1.3),
    ("threat", "WISH FATE ~2 COMMA ADJ* INSULT", 1.3),
    ("threat", "I ~2 WILL ~6 HARM ~1 YOU", 1.4),
    ("threat", "I_WILL ~6 HARM ~1 YOU", 1.4),
    ("threat", "I ~1 WILL YOU ~4 HARM", 1.4),
    ("threat", "WILL HARM YOU ~1 BODY", 1.4),
    ("threat", "YOU WILL ~2 HARM ~2 COMMA ADJ* INSULT|SOFT", 1.3),
    ("threat", "YOU WILL ~1 HARM DET BODY", 1.4),
    ("threat", "YOU WILL HARM END", 1.2),
    ("threat", "I HARM YOU BODY", 1.3),
    ("threat", "HARM_I ~1 YOU|BODY", 1.3),
    ("threat", "I YOU HARM_I", 1.3),
    ("threat", "I BRING YOU UM", 1.3),
    ("threat", "HARM YOU BODY", 0.7),
    ("threat", "HARM YOURSELF", 1.3),
    ("threat", "DISMISS AWAY COMMA ~3 INSULT|SOFT", 1.3),
    ("threat", "DISMISS FATE", 1.2),
    ("threat", "SURE ~1 YOU ~1 NEVER ~1 WALK", 1.3),
    ("threat", "I ~4 YOU ~1 NEVER WALK WALK", 1.3),
    ("threat", "I ~3 PUT YOU ~2 GRAVE", 1.3),
    ("threat", "I_WILL PUT YOU ~2 GRAVE", 1.3),
    ("threat", "WATCH YOU BACK", 1.2),
    ("threat", "KNOW WHERE ~1 YOU FIND ~12 FIND|FATE", 1.3),
    ("threat", "KNOW WHERE FIND ~4 FATE", 1.3),
    ("threat", "YOU WILL FATE", 1.0),
    ("threat", "AWAY AND HARM", 1.2),
    ("threat", "HARM ~2 BODY ~12 I ~4 YOU", 1.2),
    ("hate", "HATE ALL* DET* GROUP", 1.3),
    ("hate", "HATE ALL CAPITAL", 1.2),
    ("hate", "HATE DET CAPITAL END", 1.2),
    ("hate", "GROUP|CAPITAL ~3 BE ~2 DET|ADJ|VERY* VERMIN", 1.4),
    ("hate", "GROUP DASH VERMIN", 1.4),
    ("hate", "GROUP VERMIN|CRIME COMMA ~3 EXPEL", 1.3),
    ("hate", "GROUP ~9 BE DET|ADJ* VERMIN", 1.3),
    ("hate", "GROUP|CAPITAL BE ~1 CRIME ~8 EXPEL", 1.3),
    ("hate", "GROUP ~2 BE VERY* CRIME ~3 RIGHTS|EXPEL|MUST", 1.2),
    ("hate", "GROUP CRIME ~2 NOT ~1 RIGHTS|MUST", 1.2),
    ("hate", "ALL GROUP ~1 BE|CRIME CRIME|COMMA", 1.2),
    ("hate", "GROUP|CAPITAL ~9 NOT RIGHTS ~3 RIGHTS", 1.3),
    ("hate", "ALL CAPITAL BE RIGHTS ~2 CRIME", 1.2),
    ("hate", "ALL GROUP BE RIGHTS ~2 CRIME", 1.2),
    ("hate", "GROUP|CAPITAL ~3 BE RIGHTS ADJ ~1 ADJ", 1.2),
    ("hate", "EXPEL ALL ~4 GROUP|CAPITAL ~3 EXPEL ~8 VERMIN", 1.4),
    ("hate", "EXPEL ALL ~4 GROUP|CAPITAL ~3 EXPEL", 1.2),
    ("hate", "GROUP|CAPITAL ~3 RIGHTS ~3 RIGHTS ~6 EXPEL", 1.3),
    ("hate", "ALL GROUP ~1 EXPEL EXPEL", 1.2),
    ("hate", "GROUP ~8 BE ~2 VERMIN ~4 MUST ~2 EXPEL", 1.3),
    ("hate", "GROUP ~4 NOT BE RIGHTS RIGHTS", 1.1),
    ("hate", "VERMIN EXPEL ~2 EXPEL", 1.2),
    ("hate", "YOU MOTHER ~2 MUST BE EXPEL", 1.2),
    ("hate", "DISMISS EXPEL ~2 YOU ~1 COUNTRY", 1.2),
    ("hate", "DEATH ~2 GROUP", 1.3),
    ("sexual", "EXPLICIT ~12 EXPLICIT", 1.2),
    ("sexual", "EXPLICIT ~8 SEXUAL", 1.1),
    ("sexual", "SEXUAL ~8 EXPLICIT", 1.1),
    ("sexual", "EXPLICIT", 0.7),
    ("sexual", "BODILY ~12 SEXUAL ~12 SEXUAL", 1.1),
    ("sexual", "BODILY ~8 SEXUAL BODILY SEXUAL", 1.2),
    ("sexual", "SEXUAL ~4 SEXUAL ~4 SEXUAL", 1.0),
)

#: What a negating word takes from the words that it governs, and which words may stand between.
_DENIED = ("INSULT", "SOFT", "ADJ", "VERMIN", "CRIME", "HARM", "HARM_I", "CURSE")
_BETWEEN = ("DET", "BE", "VERY", "ADJ", "YOU")
#: What a mention takes from the words that follow.
_SAID = ("INSULT", "SOFT", "ADJ", "VERMIN", "HATE", "HARM", "EXPLICIT", "SEXUAL", "CURSE", "FATE")

#: Cyrillic letters and the Latin ones that they look like; signs and digits read as letters.
LOOKALIKE = str.maketrans("асеорхуіјѕкмтвнԁ", "aceopxyijskmtbhd")
LEET = ({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "|": "l"}, {"@": "a", "$": "s", "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "|": "l"})
_LEET = tuple(str.maketrans(x) for x in LEET)

#: Fixed value: words before the name of a people.
_OF_PEOPLE = frozenset({"the", "those", "these", "all", "les", "los", "las", "ці", "усі"})
_EDGE = ".,;:?()[]{}<>«»„“”…\"'’‘`_#~^=+/\\"
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|[\r\n]+")
_SET_APART = re.compile(r"^[^\W\d_](?:[-._*·][^\W\d_]){2,}$")
_SIGN_INSIDE = re.compile(r"[@$*|!\d]")
_REPEATED = re.compile(r"(.)\1{2,}")
_QUOTED = re.compile(r"[\"“„«]([^\"“”„«»]+)[\"”“»]|(?<!\w)['‘]([^'‘’]{1,200})['’](?!\w)")
_SPEAKER = re.compile(r"^\s*(?:\d{4}-\d\d-\d\d\S*\s+\S+\s+\w+\s+\[[^\]]*\]|[\w-]{2,24}:(?=\s)|[*\-]\s)\s*")
_MARKS = re.compile(r"[\u0300-\u036f\u200b-\u200f\ufeff\u00ad]")
_SINGLES = re.compile(r"(?:(?<!\S)[^\w\s]*[^\W\d_][^\w\s]*(?!\S)\s*){4,}")


def skeleton(token: str) -> str:
    """Lower case, without marks, look-alike letters as Latin."""
    return _MARKS.sub("", unicodedata.normalize("NFKD", token.lower().replace("’", "'"))).translate(LOOKALIKE)


def _once(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


NAMES = (*CLASSES, "YOURSELF", "CAPITAL", "DASH", "COMMA", "START", "END")
BIT = {name: 1 << at for at, name in enumerate(NAMES)}


def bits(names: tuple[str, ...] | list[str]) -> int:
    return sum(BIT[n] for n in names)


class Lexicon:
    """First transducer: classes of tokens, as bits."""

    def __init__(self) -> None:
        endings = [skeleton(e) for e in ENDINGS.split()]
        self.plain: dict[str, int] = {"yourself": BIT["YOURSELF"], "dich": BIT["YOU"]}
        listed = [(name, skeleton(w.removesuffix("-")), w.endswith("-") and len(w) > 1) for name, words in CLASSES.items() for w in words.split()]
        forms = [(name, stem) for name, stem, _ in listed] + [(name, stem + e) for name, stem, more in listed if more for e in endings]
        for name, form in forms:  # words as listed come first, so that a disguise is read as one of them if it can be
            self.plain[form] = self.plain.get(form, 0) | BIT[name]
        wanted = bits(["INSULT", "SOFT", "ADJ", "VERMIN", "EXPLICIT", "SEXUAL", "GROUP"])
        self.strong = {k: v for k, v in self.plain.items() if len(k) > 2 and v & wanted}
        self.single: dict[str, int] = {}
        self.sized: dict[int, list[str]] = {}
        for k, v in self.strong.items():
            self.single.setdefault(_once(k), v)
            self.sized.setdefault(len(k), []).append(k)
        self.known: dict[str, int] = {}

    def disguised(self, token: str, bare: str) -> int:
        """Classes of a token that no list has, read as a disguise of one that has."""
        if _SET_APART.match(token):
            return self.strong.get(re.sub(r"[-._*·]", "", bare), 0)
        if "*" in bare:
            letters = len(bare) - bare.count("*")
            if letters >= 2 and letters * 2 >= len(bare) and bare[0] != "*":
                shape = re.compile(re.escape(bare).replace(r"\*", "."))
                wanted = bits(["INSULT", "EXPLICIT", "SEXUAL"] + (["SOFT", "ADJ", "VERMIN", "GROUP"] if bare.count("*") == 1 else []))
                return next((self.strong[k] for k in self.sized.get(len(bare), ()) if self.strong[k] & wanted and shape.fullmatch(k)), 0)
        if _SIGN_INSIDE.search(token) and re.search(r"[^\W\d_]", token):
            for table in _LEET:
                if (k := bare.translate(table)) in self.strong:
                    return self.strong[k]
        if _REPEATED.search(bare) and (k := _once(bare)) in self.single:
            return self.single[k]
        return 0

    def token(self, raw: str) -> int:
        """Classes of a token; those of frequent ones are remembered."""
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            if raw in ("-", "–", "—"):
                found = BIT["DASH"]
            else:
                token = raw.strip(_EDGE).rstrip("!")
                bare = skeleton(token)
                found = self.plain.get(bare, 0)
                if not found and bare.endswith("'s"):
                    found = self.plain.get(bare[:-2], 0)
                if not found and bare[1:2] == "'":  # French elision
                    found = self.plain.get(bare[2:], 0)
                if not found and token:
                    found = self.disguised(token, bare)
            self.known[raw] = found
        return found

    def classes(self, tokens: list[str]) -> list[int]:
        """Classes of the tokens of a clause, with marks for its ends, commas and names that may be of a people."""
        out, i = [BIT["START"]], 0
        while i < len(tokens):
            j = i
            while j < len(tokens) and len(tokens[j].strip(_EDGE)) == 1 and tokens[j].strip(_EDGE).isalpha():
                j += 1
            if j - i >= 4:  # letters set apart by blanks; a one-letter word may stand before or after
                word = skeleton("".join(t.strip(_EDGE) for t in tokens[i:j]))
                out.append(next((self.strong[w] for a, b in ((0, 0), (1, 0), (0, 1), (1, 1)) if (w := word[a : len(word) - b]) in self.strong), 0))
                i = j
                continue
            raw = tokens[i]
            found = self.token(raw)
            if not found and i:
                token = raw.strip(_EDGE).rstrip("!")
                if token[:1].isupper() and len(token) > 4 and token.isalpha() and (token[-1] == "s" or tokens[i - 1].lower() in _OF_PEOPLE):
                    found = BIT["CAPITAL"]
            elif not i and not found and raw[:1].isupper() and len(raw) > 4 and raw.isalpha() and raw[-1] == "s":
                found = BIT["CAPITAL"]
            out.append(found)
            if raw[-1] in ",;:" and i + 1 < len(tokens):
                out.append(BIT["COMMA"])
            i += 1
        out.append(BIT["END"])
        return out


class Automaton:
    """Fourth transducer: all patterns as one nondeterministic automaton, whose sets of states are made deterministic as texts need them."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[int, int]]] = []
        self.skips: list[list[int]] = []
        self.final: dict[int, tuple[float, str]] = {}
        first = [self._pattern(kind, pattern, weight) for kind, pattern, weight in GRAMMAR]
        self.start = self._closure(sum(1 << s for s in first))
        self.steps: dict[tuple[int, int], tuple[int, tuple[tuple[str, float], ...]]] = {}

    def _state(self) -> int:
        self.arcs.append([])
        self.skips.append([])
        return len(self.arcs) - 1

    def _pattern(self, kind: str, pattern: str, weight: float) -> int:
        begin = at = self._state()
        for part in pattern.split():
            if part.startswith("~"):
                for _ in range(int(part[1:])):
                    to = self._state()
                    self.arcs[at].append((0, to))
                    self.skips[at].append(to)
                    at = to
                continue
            mask, to = bits(part.rstrip("*").split("|")), self._state()
            if part.endswith("*"):
                self.arcs[at].append((mask, at))
                self.skips[at].append(to)
            else:
                self.arcs[at].append((mask, to))
            at = to
        self.final[at] = (weight, kind)
        return begin

    def _closure(self, states: int) -> int:
        todo = states
        while todo:
            low = todo & -todo
            todo ^= low
            for to in self.skips[low.bit_length() - 1]:
                if not states >> to & 1:
                    states |= 1 << to
                    todo |= 1 << to
        return states

    def step(self, states: int, classes: int) -> tuple[int, tuple[tuple[str, float], ...]]:
        """The states after a token, and the best weight of each kind that ends with it."""
        known = self.steps.get((states, classes))
        if known is None:
            if len(self.steps) > KNOWN:
                self.steps.clear()
            after, rest = 0, states
            while rest:
                low = rest & -rest
                rest ^= low
                for mask, to in self.arcs[low.bit_length() - 1]:
                    if not mask or mask & classes:
                        after |= 1 << to
            after = self._closure(after) | self.start
            ended: dict[str, float] = {}
            for at, (weight, kind) in self.final.items():
                if after >> at & 1:
                    ended[kind] = max(weight, ended.get(kind, 0.0))
            known = self.steps[states, classes] = (after, tuple(ended.items()))
        return known

    def weights(self, clause: list[int]) -> dict[str, float]:
        """Weight of the best path of each kind through some part of the clause."""
        states, best = self.start, {}
        for classes in clause:
            states, ended = self.step(states, classes)
            for kind, weight in ended:
                if weight > best.get(kind, 0.0):
                    best[kind] = weight
        return best


class Grammar:
    """The composition of the transducers."""

    def __init__(self) -> None:
        self.lexicon, self.automaton = Lexicon(), Automaton()
        self.triggers, self.denied, self.between, self.said = bits(TRIGGERS), bits(_DENIED), bits(_BETWEEN), bits(_SAID)

    def spoken(self, sentence: str) -> list[str]:
        """Second transducer: the clause without what it mentions in quotation marks, and each quotation that it does not mention.

        A quotation is mentioned if a word about words stands outside of it and nobody is spoken to there.
        """
        plain = _SPEAKER.sub("", sentence)
        quotes = [m.group(1) or m.group(2) for m in _QUOTED.finditer(plain)] if _QUOTED.search(plain) else []
        if not quotes:
            return [plain]
        outside = _QUOTED.sub(" , ", plain)
        around = 0
        for t in outside.split():
            around |= self.lexicon.token(t)
        if around & BIT["MENTION"] and not around & BIT["YOU"]:
            return [outside]
        # Quoted words that are part of the clause ("the so-called 'idiot' mode") are as if they were mentioned; whole utterances are said.
        return [outside, *(q for q in quotes if len(q.split()) > 2 or any(self.lexicon.token(t) & BIT["YOU"] for t in q.split()))]

    def governed(self, clause: list[int]) -> list[int]:
        """Third transducer: what negating words and words about words govern is no abuse."""
        denies = mentions = 0
        yours = False
        for at, c in enumerate(clause):
            if c & BIT["COMMA"]:
                denies = 0
            elif denies and c & self.denied:
                clause[at] = c & ~self.denied
            elif denies and not c & self.between:
                denies -= 1
            if c & BIT["NOT"]:
                denies = 2
            yours |= bool(c & BIT["YOU"])
            if c & BIT["MENTION"]:
                mentions = 7
            elif mentions:
                mentions -= 1
                if c & self.said and not yours:
                    clause[at] &= ~self.said
        return clause

    def clause(self, sentence: str) -> tuple[float, str]:
        """Weight and kind of a sentence's best path."""
        best, kind = 0.0, ""
        for part in self.spoken(sentence):
            tokens = part.split()
            present = 0
            for t in tokens:
                present |= self.lexicon.token(t)
            if not present & self.triggers and not _SINGLES.search(part):
                continue
            clause = self.lexicon.classes(tokens)
            if present & (BIT["NOT"] | BIT["MENTION"]):
                clause = self.governed(clause)
            technical = present & BIT["TECHNICAL"] and not present & (BIT["INSULT"] | BIT["EXPLICIT"])
            for name, weight in self.automaton.weights(clause).items():
                total = weight - (0.8 if technical and name == "sexual" else 0.5 if technical and name == "threat" and not present & BIT["BODY"] else 0.0)
                if total > best:
                    best, kind = total, name
        return best, kind

    def text(self, text: str | None) -> tuple[float, str, str]:
        """Score, kind and clause of a text; (0, "", "") of a null, empty or blank one."""
        best = (0.0, "", "")
        for sentence in _SENTENCE.split(text or ""):
            if sentence and not sentence.isspace():
                weight, kind = self.clause(sentence)
                if weight > best[0]:
                    best = (weight, kind, sentence.strip())
        return best

    def suspects(self, texts: pa.Array) -> np.ndarray:
        """Whether a text has a token without which no pattern ends, or letters set apart; tokens are looked up once per batch."""
        split = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
        flat = split.flatten().dictionary_encode()
        tokens = flat.dictionary.to_pylist()
        token = self.lexicon.token
        hit = np.fromiter((bool(token(t) & self.triggers) for t in tokens), bool, len(tokens))[np.asarray(flat.indices)]
        row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
        out = np.bincount(row, hit, len(texts)) > 0
        single = np.fromiter((len(t.strip(_EDGE)) == 1 and t.strip(_EDGE).isalpha() for t in tokens), bool, len(tokens))[np.asarray(flat.indices)]
        if len(single) >= 4:
            run = single[:-3] & single[1:-2] & single[2:-1] & single[3:] & (row[:-3] == row[3:])
            out[row[:-3][run]] = True
        return out


_grammar: list[Grammar] = []


def grammar() -> Grammar:
    if not _grammar:
        _grammar.append(Grammar())
    return _grammar[0]


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = grammar()
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        found = [rules.text(t.as_py()) if s else (0.0, "", "") for t, s in zip(texts, rules.suspects(texts).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())], names=["id", "score", "kind", "clause"])


def abuse_scores(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, kind, clause) of every row, in one pass without a shuffle.

    Null, empty and blank texts score 0 with empty kind and clause.  Whole texts are read.
    """
    kind = texts.select(key).schema[0].dataType.simpleString()
    return texts.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_scores, f"id {kind}, score double, kind string, clause string").withColumnRenamed("id", key)


def abuse_rates(scores: DataFrame, by: str = "source") -> DataFrame:
    """Rows, cases and their share per source, and cases of each kind.  Null sources are ``(none)``."""
    case = F.col("score") >= CASE
    kinds = [F.count_if(case & (F.col("kind") == k)).alias(k) for k in ("insult", "threat", "hate", "sexual")]
    each = scores.groupBy(F.coalesce(by, F.lit("(none)")).alias(by)).agg(F.count(F.lit(1)).alias("rows"), F.count_if(case).alias("cases"), *kinds)
    return each.withColumn("rate", F.round(F.col("cases") / F.col("rows"), 6))
