"""Defective pairs of prompt and response, with the kind of defect.

One pass over all pairs decides what a pair shows by itself (empty, copied,
other language, structural breaks) and gathers what only the corpus can tell:

* refusals - sentences of short responses are the openings that refusals
  consist of.  Distinct sentences, names and numbers masked, are grouped by
  MinHash of their character 4-grams, verified by Jaccard similarity.  A group
  that recurs across unrelated prompts is a template; templates whose sentences
  mostly decline are refusals, whatever the spelling of a single member, and so
  are those, in whatever wording, that recur across prompts on different topics
  in responses that, but for politeness, have no word of the prompt and no number.  A
  declining sentence that does not recur needs no help only if its wording is
  unmistakable.  A response is a refusal if such sentences and politeness make
  up most of it, or,
  in a longer response, if its first sentence but for politeness and scraps is one.
* truncation - where sentences of the corpus end: how often the last two words
  of an open sentence end sentences and how often they stand within them, and
  the usual length of sentences that begin alike; counted in a second pass, for
  the pairs of words that open sentences have.  A response whose last sentence
  has no end mark breaks off if hardly a sentence ends like that, or if it is
  far shorter than its like.

Order of decisions, one defect per pair: empty, copied_question, refusal,
other_language, truncated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import defect_words as D
from sievewright.llm.components import components
from sievewright.llm.pairs import within_bound
from sievewright.operators.lineage import checkpointed

#: Words up to which all sentences of a response are kept; of a longer one its opening, so many sentences, and those that decline.
SHORT, OPENING = 60, 3
#: Unrelated prompts across which a group recurs to be a template; share of its occurrences that decline.
RECURS, DECLINES = 3, 0.5
#: Groups that the phrase list doesn't know: prompts on different topics, share of responses without a word of the prompt, words of a sentence.
SPREAD, STRANGE, LEAST = 5, 0.8, 4
#: Entries that a task keeps before it passes counts on, and words or sentences that it remembers.
HELD, KNOWN = 1_000_000, 200_000
#: Share of the occurrences of two words, of those that a word follows or an end mark closes, at which an end is no end.
RARE = 0.005
#: Bits of the filter of wanted keys (8 MB at any size of the table; more keys than bits let more counts pass, not fewer).
FILTER_BITS = 26
#: Jaccard similarity of 4-grams within a group; bands and rows of the MinHash.
SIMILAR, BANDS, ROWS = 0.6, 10, 3
#: Sentences with one beginning before their length counts; share of them that may be hardly longer, and by how many words.
ALIKE, SHORTER, CLOSE = 20, 0.02, 2

_WORD = re.compile(r"[^\W_]+(?:[’'][^\W_]+)?")
_FENCE = re.compile(r"```.*?```", re.S)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»')]*\s+|\n+")
_END = re.compile(r"[.!?…。][\"”»’')*\]]*$")
_QUOTED = re.compile(r"[\"“„«][^\"“”„«»]{1,160}[\"”“»]|(?<!\w)['‘][^'‘’]{1,160}['’](?!\w)")
_NAME = re.compile(r"(?<=\S )[A-ZА-ЯІЇЄҐ][^\W\d_]{3,}(?:-\d+)?")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)?")
_EDGE = ".,;:!?…。()[]{}<>«»„“”\"'’‘`*_#~|/\\-"
_BULLET = re.compile(r"\s*(?:[-*•]|\d+[.)])\s+")
_LABEL = re.compile(r":\s*\S{1,24}$")
_CODE_LINE = re.compile(r"^\s*(?:def |class |for .*:$|if .*:$|return\b|import |from \w+ import|SELECT\b|FROM\b|WHERE\b|GROUP BY|ORDER BY|print\(|\w[\w.\[\]\"']* ?=|[\]})]|result\.|continue$|else:|\w+\()")
_EDIT = re.compile(D.EDIT_REQUEST, re.I)
_DECLINE = re.compile(D.DECLINE, re.S)
_COURTESY = re.compile(D.COURTESY)
_PARTS = "|".join(map(re.escape, D.DECLINE_PARTS))
_COURTESY_PARTS = D.COURTESY.replace(r"\b", "")
_QUOTES = re.compile("[\"“„«'‘]")
_CYRILLIC = re.compile(r"[а-яіїєґ]")
_LABELS = frozenset("q question asked you instruction prompt frage pregunta питання запитання".split())
_PLACEHOLDERS = frozenset(D.PLACEHOLDERS.split("|"))

_weights: dict[str, list[tuple[str, float]]] = {}
for _code, _list in D.FREQUENT.items():
    for _w in set(_list.split()):
        _weights.setdefault(_w, []).append((_code, 1.0))
FREQUENT = {w: [(c, 1.0 / len(x)) for c, _ in x] for w, x in _weights.items()}
_FREQUENT_WORDS = frozenset(FREQUENT)
_NAMES = {n: code for code, names in D.LANGUAGE_NAMES.items() for n in names.split()}
_NAME_WORDS = frozenset(_NAMES)
_ASKED = re.compile(r"\b(?:in|into|to|auf|ins|en|au|al|a|на)?\s*(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")\b", re.I)
_REPLY = re.compile(r"answer|reply|respond|write|say|translate|give|antwort|schreib|übersetz|réponds|répond|écris|tradui|responde|contesta|escribe|traduce|відпові|напиши|переклад|дай", re.I)


LANGUAGES = tuple(sorted(D.FREQUENT))
_UK = LANGUAGES.index("uk")


def main_language(weights: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The language (its place in LANGUAGES, else -1) of each text that outweighs every other clearly."""
    best = len(LANGUAGES) - 1 - np.argmax(weights[:, ::-1], axis=1)
    ordered = np.sort(weights, axis=1)
    first, second = ordered[:, -1], ordered[:, -2]
    return np.where((first >= 1.5) & (first >= 0.06 * words) & (first >= 1.4 * second), best, -1)


def asked_language(question: str) -> str | None:
    """Language that the question asks the answer to be in."""
    for sentence in _SENTENCE.split(question):
        if _REPLY.search(sentence):
            found = _ASKED.findall(sentence)
            if found:
                return _NAMES[found[-1].lower()]
    return None


def is_empty(answer: str | None) -> bool:
    """Null, blank, only signs, or a placeholder."""
    if answer and len(answer) > 200:
        return not any(map(str.isalnum, answer))
    words = _WORD.findall((answer or "").lower())
    return not words or (len(words) <= 3 and " ".join(words) in _PLACEHOLDERS)


def asks_back(question: str, answer: str) -> bool:
    """Whether the question asks for its own text back, in another form, in words that the answer does not repeat."""
    asks = _EDIT.search(question)
    return bool(asks) and asks.group(0).lower() not in answer.lower()


def broken_structure(answer: str) -> bool | None:
    """True if code or brackets are left open, False if code or an end mark closes the answer, None if its last words must tell."""
    text = answer.rstrip()
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    bare = _FENCE.sub(" ", text)
    tail = bare.rsplit("\n\n", 1)[-1]
    last = text.rsplit("\n", 1)[-1]
    braces = any(tail.count(o) > tail.count(c) for o, c in ("[]", "{}", "()"))
    if braces and (tail.count("{") or tail.count("[") or _CODE_LINE.search(last)):
        return True
    if _END.search(text[-12:]):
        return False
    if text[-1] in ",;([{=+\\&/<" or (text[-1] == ":" and len(text) > 12):
        return True
    sentence = _SENTENCE.split(last)[-1]
    if sentence.count("(") > sentence.count(")") or sentence.count('"') % 2:
        return True
    if _CODE_LINE.search(last):
        body = text[text.rfind("def ") :] if "def " in text else ""
        return bool(body) and "\n" in body and not re.search(r"\n\s+(?:return|yield|raise|print)\b", body)
    return False if text[-1] in "`\"”»)]}" else None


def _masked(token: str, first: bool) -> str:
    """Word of a token in lower case; names (capitalised within the sentence) and numbers masked."""
    w = token.strip(_EDGE)
    return "#" if w[:1].isdigit() else "N" if not first and w[:1].isupper() and len(w) > 3 else w.lower()


_PAIR = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    """Hash of a word; those of frequent words are remembered."""
    h = _hashes.get(word)
    if h is None:
        if len(_hashes) > KNOWN:
            _hashes.clear()
        h = _hashes[word] = xxhash.xxh3_64_intdigest(word)
    return h


def pair_key(a: int, b: int) -> int:
    """Key of two words, from their hashes."""
    x = ((a * _PAIR[0] + b) * _PAIR[1]) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 31)) - 2**63


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``pair_key`` of arrays."""
    x = (a * np.uint64(_PAIR[0]) + b) * np.uint64(_PAIR[1])
    return (x ^ (x >> np.uint64(31)) ^ np.uint64(2**63)).view(np.int64)


def sentence_keys(tokens: list[str]) -> tuple[int, int]:
    """Keys of a sentence's last two and first two words."""
    word = lambda i: _hash(_masked(tokens[i], i == 0))
    return pair_key(word(len(tokens) - 2), word(len(tokens) - 1)), pair_key(word(0), word(1))


def _key(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - 2**63


def masked_sentence(sentence: str) -> str:
    """A sentence as template: names as N, numbers as 0, blanks and apostrophes of one kind, lower case."""
    s = " ".join(sentence.split()).replace("’", "'").replace("‘", "'")
    return _NUMBER.sub("0", _NAME.sub("N", s)).lower().strip(" .!?…*-#_")


def declines(sentence: str) -> bool:
    """Whether a sentence, without what it quotes, declines."""
    return declining([sentence])[0]


def declining(sentences: list[str]) -> list[bool]:
    """``declines`` of many sentences: those that have a part of a way to decline are looked for all at once."""
    if not sentences:
        return []
    low = pc.utf8_lower(pa.array(sentences, pa.large_string()))
    out = np.asarray(pc.match_substring_regex(low, _PARTS)).tolist()
    for i in np.flatnonzero(out):
        s = sentences[i].lower()
        out[i] = bool(_DECLINE.search(_QUOTED.sub(" ", s) if _QUOTES.search(s) else s))
    return out


def courteous(sentences: list[str]) -> list[bool]:
    """Which of many masked sentences are politeness."""
    if not sentences:
        return []
    out = np.asarray(pc.match_substring_regex(pa.array(sentences, pa.large_string()), _COURTESY_PARTS)).tolist()
    for i in np.flatnonzero(out):
        out[i] = bool(_COURTESY.search(sentences[i]))
    return out


class Words:
    """What the words of a batch of questions and answers tell; words are runs without blanks, without signs at their ends, in lower case.

    ``count``: words of each answer; ``copied``: hardly a word but the question's, and most of those; ``spoken``, ``asked``: main languages;
    ``strange``: no content word of the question in the answer; ``topic``: the least hash of the question's content words (related
    questions mostly have it in common); ``foreign(row, wanted)``: whether the answer is in another language than the wanted one.
    """

    def __init__(self, questions: list[str], answers: list[str], strip: Callable[[str], str] = lambda t: t.strip(_EDGE)) -> None:
        n = len(questions)
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(questions + answers, pa.large_string())))
        flat = split.flatten().dictionary_encode()
        ids: dict[str, int] = {}
        of_token = np.fromiter((ids.setdefault(strip(t), len(ids)) for t in flat.dictionary.to_pylist()), np.int64, len(flat.dictionary))
        number = of_token[np.asarray(flat.indices)]
        row = np.repeat(np.arange(2 * n), np.diff(np.asarray(split.offsets)))
        if "" in ids:
            row, number = row[number != ids[""]], number[number != ids[""]]
        self.count = np.bincount(row, minlength=2 * n)[n:]
        size = max(1, len(ids))
        pair = np.sort(row * size + number)
        pair = pair[np.concatenate((np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1]))]
        row, number = pair // size, pair % size
        words = list(ids)
        known = lambda f, kind: np.fromiter(map(f, words), kind, len(words))
        table = np.zeros((len(words), len(LANGUAGES)))
        for at, w in enumerate(words):
            for code, weight in FREQUENT.get(w, ()):
                table[at, LANGUAGES.index(code)] = weight
        distinct = np.bincount(row, minlength=2 * n)
        weights = np.stack([np.bincount(row, table[number, k], 2 * n) for k in range(len(LANGUAGES))], axis=1)
        cyrillic = np.bincount(row, known(lambda w: bool(_CYRILLIC.search(w)), bool)[number], 2 * n)
        weights[:, _UK] += np.where(2 * cyrillic > distinct, 0.4 * cyrillic, 0.0)
        main = main_language(weights, distinct)
        self.asked, self.spoken, self._weights, self._questions = main[:n], main[n:], weights[n:], weights[:n]
        self.names = np.bincount(row, known(lambda w: w in _NAME_WORDS, bool)[number], 2 * n)[:n] > 0
        begin = np.searchsorted(row, n)
        q_row, q, a_row, a = row[:begin], number[:begin], row[begin:] - n, number[begin:]
        in_answer = np.isin(q_row * size + q, a_row * size + a, assume_unique=True)
        common = np.bincount(q_row[in_answer], minlength=n)
        label = known(lambda w: w in _LABELS, bool)
        labels = np.bincount(a_row, label[a], n) - np.bincount(q_row[in_answer], label[q[in_answer]], n)  # "Question: ..."
        theirs, mine = distinct[:n], distinct[n:]
        few = np.where(mine < 20, mine - labels, mine)
        self.copied = (mine >= 3) & (theirs > 0) & (common >= 0.88 * few) & (common >= 0.65 * theirs)
        content = known(lambda w: len(w) > 3 and not w.isdigit() and w not in _FREQUENT_WORDS, bool)
        self.strange = np.bincount(q_row, content[q] & in_answer, n) == 0
        hashes = np.where(content, known(_hash, np.uint64), np.uint64(2**63))
        least = np.full(n, np.uint64(2**63))
        np.minimum.at(least, q_row, hashes[q])
        self.topic = (least ^ np.uint64(2**63)).view(np.int64)

    def foreign(self, row: int, wanted: int, asked_for: bool) -> bool:
        got = self.spoken[row]
        if got < 0 or wanted < 0 or got == wanted or self._weights[row, wanted] >= 0.35 * self._weights[row, got]:
            return False
        return asked_for or self._questions[row, got] < 0.5 * self._questions[row, wanted]


SCHEMA = "table_name string, row_key string, verdict string, prompt bigint, words int, sentences array<string>, end_key bigint, open_key bigint, length int, topic bigint, strange boolean"
_NAMES_OUT = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES_OUT)


def examine(question: str, answer: str, words: Words, row: int) -> tuple:
    """(verdict, sentences, key of the last words, key of the last sentence's beginning, its length)."""
    if words.copied[row] and not asks_back(question, answer):
        return "copied_question", None, None, None, None
    count, verdict = int(words.count[row]), None
    if count >= 4 and words.spoken[row] >= 0:
        asked = asked_language(question) if words.names[row] else None
        if words.foreign(row, LANGUAGES.index(asked) if asked else words.asked[row], asked is not None):
            verdict = "other_language"
    prose = _FENCE.sub("\n", answer) if "```" in answer else answer
    sentences = [s for s in _SENTENCE.split(prose) if s and not s.isspace()]
    closed = broken_structure(answer)
    if closed:
        return verdict or "truncated", sentences, None, None, None
    last = _BULLET.sub("", sentences[-1], count=1).split() if closed is None and sentences else None
    if last:
        if last[-1].strip(_EDGE).lower() in D.CONNECTORS and count > 2:
            return verdict or "truncated", sentences, None, None, None
        if len(last) >= 4 and count > 4 and not _LABEL.search(answer.rstrip()):
            return verdict, sentences, *sentence_keys(last), len(last)
    return verdict, sentences, None, None, None


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, keys, questions, answers = (c.to_pylist() for c in batch.columns)
        questions = [q or "" for q in questions]
        words = Words(questions, [_FENCE.sub("\n", a) if a and "```" in a else a or "" for a in answers])
        found = [("empty", None, None, None, None) if is_empty(a) else examine(q, a, words, at) for at, (q, a) in enumerate(zip(questions, answers, strict=True))]
        long = [(at, i) for at, f in enumerate(found) if f[1] and words.count[at] > SHORT for i in range(OPENING, len(f[1]))]
        kept: dict[int, list[int]] = {}  # declining sentences after the opening
        for (at, i), d in zip(long, declining([found[at][1][i] for at, i in long]), strict=True):
            if d:
                kept.setdefault(at, []).append(i)
        fenced = [at for at, a in enumerate(answers) if found[at][1] and words.strange[at] and "```" in a]
        if fenced:  # code counts as part of the answer where words of the prompt are looked for
            words.strange[fenced] = Words([questions[at] for at in fenced], [answers[at] for at in fenced]).strange
        # Politeness around a template may name the prompt's subject; what is left of a short response decides.
        polite = [(at, i) for at, f in enumerate(found) if f[1] and len(f[1]) > 1 and words.count[at] <= SHORT and not words.strange[at] for i in range(len(f[1]))]
        dropped: dict[int, set[int]] = {}
        for (at, i), c in zip(polite, courteous([masked_sentence(found[at][1][i]) for at, i in polite]), strict=True):
            if c:
                dropped.setdefault(at, set()).add(i)
        if dropped:
            left = [" ".join(x for i, x in enumerate(found[at][1]) if i not in gone) for at, gone in dropped.items()]
            words.strange[list(dropped)] = Words([questions[at] for at in dropped], left).strange & np.array([bool(x) for x in left])
        rows = []
        for at, (name, key, question, (verdict, sentences, end, begin, length)) in enumerate(zip(names, keys, questions, found, strict=True)):
            count = 0 if verdict == "empty" else int(words.count[at])
            short = sentences and [sentences[i].strip() for i in (range(len(sentences)) if count <= SHORT else [*range(min(OPENING, len(sentences))), *kept.get(at, ())])]
            if verdict or short or end is not None:
                strange = bool(words.strange[at]) if short else None
                prompt = xxhash.xxh3_64_intdigest(question.lower()) - 2**63
                rows.append((name, key, verdict, prompt, count, short, end, begin, length, int(words.topic[at]) if strange else None, strange))
        yield _batch(rows)


_tokens: dict[str, tuple[int, int]] = {}


def _token(token: str) -> tuple[int, int]:
    """Hashes of a token as a word within a sentence and as its first; those of frequent tokens are remembered."""
    found = _tokens.get(token)
    if found is None:
        if len(_tokens) > KNOWN:
            _tokens.clear()
        found = _tokens[token] = (_hash(_masked(token, False)), _hash(_masked(token, True)))
    return found


_ITEM = re.compile(r"(?:[-*•]|\d+[.)])$")


def word_pairs(answers: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pairs of words that end a sentence with an end mark, of those that a further word of the sentence follows, and
    of each ended sentence of three words and more the key of its first two words and its length."""
    plain = pc.replace_substring_regex(pc.fill_null(answers, ""), "(?s)```.*?```", "\n")
    split = pc.utf8_split_whitespace(pc.replace_substring_regex(plain, r"\n+", " \x01 "))
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    flat = split.flatten().dictionary_encode()
    known, number = flat.dictionary.to_pylist(), np.asarray(flat.indices).astype(np.int64)
    of_words = lambda f, kind: np.fromiter(map(f, known), kind, len(known))[number]
    n, offsets = len(number), np.asarray(split.offsets).astype(np.int64)
    shifted = lambda x: np.concatenate((np.zeros(1, bool), x))[:n]
    begins = np.zeros(n + 1, bool)
    begins[offsets - offsets[0]] = True
    begins = begins[:n]
    line, closes = of_words(lambda t: t == "\x01", bool), of_words(lambda t: bool(_END.search(t)), bool)
    gap = line | (of_words(lambda t: bool(_ITEM.match(t)), bool) & (begins | shifted(line)))  # no word of a sentence
    start = begins | shifted(gap | closes)
    place = np.arange(n)
    length = place - np.maximum.accumulate(np.where(start, place, 0)) + 1
    goes_on = np.concatenate((~start[1:] & ~gap[1:], np.zeros(min(n, 1), bool)))
    told = np.array([_token(t) for t in known], np.uint64).reshape(-1, 2)
    word, first = told[number, 0], told[number, 1]
    at = np.flatnonzero(~start & ~gap)
    keys, end, whole = pair_keys(word[at - 1], word[at]), closes[at], length[at] >= 3
    last = at[end & whole]
    head = last - length[last] + 1
    return keys[end & whole], keys[~end & goes_on[at]], pair_keys(first[head], word[head + 1]), length[last]


def _counting(wanted: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts (kind, key, length, n) of the pairs in texts whose bit is set in ``wanted``; kind 0: at an end, 1: within, 2: sentences that begin so."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            for kind in range(3):
                own = [(k, s) for t, k, s in held if t == kind]
                if own:
                    keys, sizes = (np.concatenate(x) for x in zip(*own, strict=True))
                    order = np.lexsort((sizes, keys)) if kind == 2 else np.argsort(keys)
                    keys, sizes = keys[order], sizes[order]
                    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1])))) if len(keys) else np.zeros(0, np.int64)
                    n = np.diff(np.append(first, len(keys)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(keys[first]), pa.array(sizes[first]), pa.array(n)], names=["kind", "key", "length", "n"])
            held.clear()

        for batch in batches:
            end, within, head, length = word_pairs(batch.column(0))
            for kind, keys, sizes in ((0, end, None), (1, within, None), (2, head, np.minimum(length, 200).astype(np.int32))):
                bucket = keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
                keep = (wanted[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1 == 1
                own = keys[keep]
                held.append((kind, own, np.zeros(len(own), np.int32) if sizes is None else sizes[keep]))
            if sum(len(k) for _, k, _ in held) > HELD:
                yield from out()
        yield from out()

    return run


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the keys (key), 2 ** FILTER_BITS of them in bytes; made by aggregation, at most 2 ** (FILTER_BITS - 15) rows reach the driver."""
    bucket = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    found = keys.select(F.shiftright(bucket, 15).alias("part"), F.pmod(bucket, F.lit(32_768)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((2 ** (FILTER_BITS - 15), 4096), np.uint8)
    for part, bits in found:
        out[part] = np.frombuffer(bits, np.uint8)
    return out.ravel()


_RNG = np.random.default_rng(50_021)
_GA = _RNG.integers(1, 2**62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GB = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_GC = _RNG.integers(1, 2**62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character 4-grams of all texts, and how many each text has."""
    padded = [f" {t} ".ljust(4) for t in texts]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gram = sum(code[j : len(code) - 3 + j] * _GC[j] for j in range(4))
    gram ^= gram >> np.uint64(31)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    inside = np.arange(len(gram)) - np.repeat(begin, size)[: len(gram)] <= np.repeat(size, size)[: len(gram)] - 4
    return gram[inside], size - 3


def sentence_bands(texts: list[str]) -> np.ndarray:
    """Band keys of the MinHash of each text's character 4-grams, all texts at once; one row per text."""
    gram, count = _gram_hashes(texts)
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    out = np.empty((len(texts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(texts), np.uint64(band + 1))
        for r in range(band * ROWS, band * ROWS + ROWS):
            value = np.minimum.reduceat((gram * _GA[r] + _GB[r]) >> np.uint64(20), start)
            key = (key ^ value) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out.view(np.int64)


def gram_sets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct 4-gram hashes of each text in order, their number, and a bit map of 512 bits, in which two sets differ in no more bits than in grams."""
    gram, count = _gram_hashes(texts)
    row = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    once = np.concatenate(([True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])))
    gram, row = gram[once], row[once]
    bits = np.zeros((len(texts), 512), bool)
    bits[row, (gram >> np.uint64(7)) & np.uint64(511)] = True
    size = np.bincount(row, minlength=len(texts))
    return np.split(gram, np.cumsum(size)[:-1]), size, np.packbits(bits, axis=1).view(np.uint64)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similar sentences of a bucket, of rows (band, id, text) sorted by band: each with the representatives that it is similar to, or one itself.

    Representatives are compared by bit maps, all at once, and those that can be similar by their grams.
    """
    band, seen, grams, sizes, maps, ids = None, set(), [], np.zeros(0, np.int64), np.zeros((0, 8), np.uint64), []
    held = 0
    for batch in batches:
        a, b = [], []
        bands = np.asarray(batch.column(0))
        same = bands[1:] == bands[:-1]
        # a sentence that is alone in its bucket needs no comparison; the ends of a batch may go on in others
        met = np.concatenate((same, [True])) | np.concatenate(([True], same)) if len(bands) else np.zeros(0, bool)
        batch = batch.filter(pa.array(met))
        own, counts, bits = gram_sets(batch.column(2).to_pylist()) if batch.num_rows else ([], (), ())
        for at, i, x, n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own, counts, bits, strict=True):
            if at != band:
                band, seen, grams, held, ids = at, set(), [], 0, []
            if i in seen:
                continue
            seen.add(i)
            alone = True
            if held:
                apart = np.bitwise_count(maps[:held] ^ m).sum(axis=1)
                # of n + k grams at least SIMILAR / (1 + SIMILAR) are common, so this many may differ
                for j in np.flatnonzero(apart <= (n + sizes[:held]) * ((1 - SIMILAR) / (1 + SIMILAR))):
                    common = len(np.intersect1d(x, grams[j], assume_unique=True))
                    if common >= SIMILAR * (n + sizes[j] - common):
                        a.append(i)
                        b.append(ids[j])
                        alone = False
            if alone:
                if held == len(sizes):
                    sizes, maps = np.resize(sizes, 2 * held + 8), np.resize(maps, (2 * held + 8, 8))
                sizes[held], maps[held] = n, m
                grams.append(x)
                ids.append(i)
                held += 1
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


_SAID = (
    ("table_name", "string", pa.string()), ("row_key", "string", pa.string()), ("prompt", "bigint", pa.int64()), ("id", "bigint", pa.int64()), ("text", "string", pa.string()),
    ("length", "int", pa.int32()), ("all", "int", pa.int32()), ("polite_all", "int", pa.int32()), ("declines", "boolean", pa.bool_()), ("polite", "boolean", pa.bool_()), ("topic", "bigint", pa.int64()), ("strange", "boolean", pa.bool_()), ("open", "boolean", pa.bool_()), ("leads", "boolean", pa.bool_()), ("bands", "array<bigint>", pa.list_(pa.int64())),
)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences of responses.  A task gives the bands, and the text of one that doesn't decline, with the first of equal sentences only."""
    seen: set[tuple[int, bool]] = set()
    for batch in batches:
        out, new = [], {}
        texts = list(dict.fromkeys(batch.column(6).flatten().to_pylist()))
        masks = [masked_sentence(t) for t in texts]
        facts = zip(masks, [len(t.split()) for t in texts], declining(texts), courteous(masks), [_key([m]) for m in masks], strict=True)
        known = dict(zip(texts, facts, strict=True))
        for name, key, prompt, about, strange, words, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = [told for s in listed if (told := known[s])[0]]
            total, polite = sum(f[1] for f in found), sum(f[1] for f in found if f[3])
            total = max(total, words) if words > SHORT else total
            lead = next((at for at, f in enumerate(found) if not f[3] and (f[2] or f[1] >= LEAST)), None) if words > SHORT else None
            for at, (m, length, d, p, i) in enumerate(found):
                free = bool(strange) and "0" not in m and length >= (2 * LEAST if p else LEAST)  # may be of a template that the list doesn't know
                if (i, free) not in seen:
                    seen.add((i, free))
                    new[len(out)] = m
                out.append([name, key, prompt, i, m if d or len(out) in new else None, length, total, polite, d, p, about, strange, free, at == lead, None])
        if len(seen) > HELD:
            seen = set()
        if new:
            for at, bands in zip(new, sentence_bands(list(new.values())).tolist(), strict=True):
                out[at][-1] = bands
        columns = list(zip(*out, strict=True)) if out else [()] * len(_SAID)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, _SAID, strict=True)], names=[n for n, _, _ in _SAID])


def refusals(rows: DataFrame) -> DataFrame:
    """(table_name, row_key) of the refusals among responses (table_name, row_key, prompt, topic, strange, words, sentences).

    In each bucket of a band every sentence is compared with the bucket's representatives, those that are similar to
    no earlier one.  A sentence that neither declines nor stands in a response without words of its prompt can only
    belong to a template of declining ones, so it is left out of buckets without one.
    """
    said = rows.select("table_name", "row_key", "prompt", "topic", "strange", "words", "sentences").mapInArrow(_parts, ", ".join(f"`{n}` {k}" for n, k, _ in _SAID)).persist(StorageLevel.MEMORY_AND_DISK)
    banded = said.where("bands is not null").select(F.explode("bands").alias("band"), "id", "text", (F.col("declines") | F.col("open")).alias("any"), "declines")
    known = within_bound(banded.where("declines").select("band").distinct(), cut=True)
    met = banded.where("any").unionByName(banded.where("not any").join(known, "band", "left_semi")).select("band", "id", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    similar = checkpointed(met.repartition(parts, "band").sortWithinPartitions("band", "id").mapInArrow(_similar, "a bigint, b bigint").distinct())
    involved = similar.select(F.explode(F.array("a", "b")).alias("id")).unionByName(said.where("declines or open").select("id")).distinct()
    each = said.select("id", "prompt", "topic", "strange", "declines").join(within_bound(involved, cut=True), "id", "left_semi").groupBy("id", "prompt", "topic")
    each = each.agg(F.count(F.lit(1)).alias("n"), F.count_if("declines").alias("d"), F.count_if("strange").alias("s")).join(components(similar), "id", "left").withColumn("component", F.coalesce("component", "id"))
    each = checkpointed(each)
    about = each.where("s > 0").select("component", "topic").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("topics"))
    grouped = each.groupBy("id", "component").agg(F.count(F.lit(1)).alias("prompts"), F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("s").alias("s")).persist(StorageLevel.MEMORY_AND_DISK)
    group = grouped.groupBy("component").agg(F.sum("prompts").alias("prompts"), F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("s").alias("s")).join(about, "component", "left")
    template = (F.col("prompts") >= RECURS) & (F.col("d") >= DECLINES * F.col("n"))
    spread = F.coalesce((F.col("topics") >= SPREAD) & (F.col("s") >= STRANGE * F.col("n")), F.lit(False))
    named = grouped.select("id", "component", F.col("d").alias("own")).join(group, "component")
    refusing = named.select("id", (template | (F.col("own") > 0)).alias("known"), spread.alias("spread")).where("known or spread")
    told = said.select("table_name", "row_key", "id", "length", "all", "polite_all", "polite", "open", "leads").join(within_bound(refusing, cut=True), "id").where("known or open")
    total = told.groupBy("table_name", "row_key").agg(F.first("all").alias("all"), F.first("polite_all").alias("polite_all"), F.sum(F.when(~F.col("polite"), F.col("length")).otherwise(0)).alias("plain"), F.bool_or(F.col("leads") & F.col("known")).alias("leads"))
    return total.where(F.col("leads") | (F.col("plain") + F.col("polite_all") >= 0.6 * F.col("all"))).select("table_name", "row_key")


def truncations(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(table_name, row_key) of responses (end_key, open_key, length) whose last sentence, without an end mark, is no whole one, by the sentences of ``answers`` (answer)."""
    keys = rows.select(F.explode(F.array("end_key", "open_key")).alias("key")).where("key is not null")
    wanted = key_filter(keys)
    counts = answers.select("answer").mapInArrow(_counting(wanted), "kind int, key bigint, length int, n bigint").groupBy("kind", "key", "length").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    seen = counts.where("kind < 2").groupBy(F.col("key").alias("end_key")).agg(F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("ends"), F.sum("n").alias("all"))
    lengths = counts.where("kind = 2").select(F.col("key").alias("open_key"), F.col("length").alias("words"), "n")
    each = rows.select("table_name", "row_key", "end_key", "open_key", "length")
    shorter = each.select("open_key", "length").distinct().join(lengths, "open_key")
    shorter = shorter.groupBy("open_key", "length").agg(F.sum("n").alias("alike"), F.sum(F.when(F.col("words") <= F.col("length") + CLOSE, F.col("n")).otherwise(0)).alias("shorter"))
    joined = each.join(seen, "end_key", "left").join(shorter, ["open_key", "length"], "left")
    brief = (F.coalesce("alike", F.lit(0)) >= ALIKE) & (F.col("shorter") < SHORTER * F.col("alike"))
    open_ = F.coalesce(F.col("ends") < RARE * F.col("all"), F.lit(True)) | (F.col("ends") == 0)
    return joined.where(open_ | brief).select("table_name", "row_key")


def pair_defects(pairs: DataFrame) -> DataFrame:
    """(table_name, row_key, defect) of the defective among pairs (table_name, row_key, question, answer).

    Null question counts as empty; null, blank and placeholder answers are ``empty``.  A row that comes twice is given
    once; rows without key are left out.  Extra columns are ignored.  Of an empty table the result is empty.
    """
    base = pairs.select("table_name", F.col("row_key").cast("string").alias("row_key"), "question", "answer").where("row_key is not null")
    rows = base.mapInArrow(_examine, SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
    key = ["table_name", "row_key"]
    refusal = refusals(rows.where("sentences is not null and (verdict is null or verdict in ('other_language', 'truncated'))"))
    broken = truncations(rows.where("end_key is not null and verdict is null"), base)
    rank = F.create_map(*[x for i, d in enumerate(("empty", "copied_question", "refusal", "other_language", "truncated")) for x in (F.lit(d), F.lit(i))])
    every = rows.where("verdict is not null").select(*key, F.col("verdict").alias("defect")).unionByName(refusal.withColumn("defect", F.lit("refusal"))).unionByName(broken.withColumn("defect", F.lit("truncated")))
    return every.groupBy(*key).agg(F.min_by("defect", rank[F.col("defect")]).alias("defect"))
