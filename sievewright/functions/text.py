"""Text as Column expressions; everything stays in the JVM.

Null text behaves as empty text unless a function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions import lexicon as L

#: All white space, with the separators that a plain \\s leaves out.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(values: Sequence[str]) -> Column:
    """Array literal of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; a lambda would compute what it takes from outside for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def term_sequence(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 in order; other letters separate."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("([a-z0-9]+)"), F.lit(1))


def terms(text: Column) -> Column:
    """Distinct terms in order of first appearance."""
    return F.array_distinct(term_sequence(text))


def terms_of(values: Column) -> Column:
    """Distinct terms of all strings of an array; null arrays have none."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), term_sequence)))


def squashed(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text_or_empty(text), _SPACE, " "), "^ | $", "")


def normalized(text: Column) -> Column:
    """Lower case, ASCII punctuation as blanks, white space squashed."""
    return squashed(F.translate(F.lower(text_or_empty(text)), _PUNCTUATION, " " * len(_PUNCTUATION)))


def normalized_list(values: Column) -> Column:
    """Normalized strings of an array, without empty ones and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), normalized), lambda v: v != ""))


def content_terms(text: Column, stop_words: Sequence[str] = L.STOP_WORDS) -> Column:
    """Terms in order that are longer than two letters and no stop words."""
    return F.filter(term_sequence(text), lambda t: (F.length(t) > 2) & ~t.isin(*stop_words))


def top_keywords(text: Column, limit: int = 12, stop_words: Sequence[str] = L.STOP_WORDS) -> Column:
    """Most frequent content terms, ties by name.  For short texts; see ``operators.keywords`` for long ones."""

    def ranked(both: Column) -> Column:
        # In sorted terms equal ones stand together, so a term's count follows from its first place and its last.
        ordered, backwards = both["o"], both["b"]
        count = lambda t: F.size(ordered) + 2 - F.array_position(backwards, t) - F.array_position(ordered, t)
        counted = F.transform(F.array_distinct(ordered), lambda t: F.struct((-count(t)).alias("n"), t.alias("t")))
        return F.slice(F.transform(F.array_sort(counted), lambda c: c["t"]), 1, limit)

    return let(let(F.array_sort(content_terms(text, stop_words)), lambda o: F.struct(o.alias("o"), F.reverse(o).alias("b"))), ranked)


def domains_of(found: Column, domain_words: Mapping[str, Sequence[str]] = L.DOMAIN_WORDS, labels: Mapping[str, Sequence[str]] = L.DOMAIN_LABELS, fallback: str = L.FALLBACK_DOMAIN) -> Column:
    """Labels of the domains that share a term, in lexicon order; the fallback if none does."""

    def labelled(terms_: Column) -> Column:
        each = [F.when(F.arrays_overlap(terms_, words(ws)), words(labels.get(d, (d,)))) for d, ws in domain_words.items()]
        return F.array_distinct(F.flatten(F.filter(F.array(*each), lambda x: x.isNotNull())))

    return let(let(found, labelled), lambda listed: F.when(F.size(listed) > 0, listed).otherwise(words((fallback,))))


def has_any(lowered: Column, parts: Sequence[str]) -> Column:
    """Whether a lower-case text contains one of the substrings; one pattern, so that the text is an input once."""
    return F.rlike(lowered, F.lit("|".join(re.escape(p) for p in parts)))


def sample_type(text: Column, default: str = "unknown") -> Column:
    """Sample type by the first list of substrings of which one occurs, then by a question mark."""
    lowered, out = F.lower(text_or_empty(text)), None
    for name, cues in L.SAMPLE_CUES:
        out = F.when(has_any(lowered, cues), name) if out is None else out.when(has_any(lowered, cues), name)
    return out.when(F.contains(text_or_empty(text), F.lit("?")), "factual_qa").otherwise(default if default in L.SAMPLE_TYPES else "unknown")


def slug(text: Column, fallback: str = "unknown") -> Column:
    """Lower-case letters and digits, anything else as single hyphens."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.when(bare == "", fallback).otherwise(bare)


def title_from_terms(listed: Column, fallback: str = "Group") -> Column:
    """At most three terms as one capitalized word; a letter after anything but a letter is capital."""
    pieces = F.flatten(F.transform(F.slice(listed, 1, 3), lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))))
    joined = F.array_join(F.transform(pieces, lambda p: F.regexp_replace(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))), "[-_ ]", "")), "")
    return F.when(F.coalesce(joined, F.lit("")) == "", fallback).otherwise(joined)


def shortened(text: Column, limit: int = 120) -> Column:
    """At most ``limit`` characters of squashed text, the last three as dots if it is longer."""
    plain = squashed(text)
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, limit - 3)), F.lit("...")))


def polarity(normal: Column) -> Column:
    """-1 if an opposite or a negation occurs as a substring of normalized text, else 1 if a positive phrase does, else 0."""
    return let(normal, lambda n: F.when(has_any(n, [n for _, n in L.OPPOSITES] + list(L.NEGATION_MARKERS)), -1).when(has_any(n, [p for p, _ in L.OPPOSITES]), 1).otherwise(0))


def overlap(left: Column, right: Column) -> Column:
    """Shared values over the size of the smaller of two sets; 0 if one is empty."""
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller > 0, F.size(F.array_intersect(left, right)) / smaller).otherwise(0.0)


def is_repetitive(text: Column) -> Column:
    """Fewer than five words, or less than 35 of 100 words distinct; words without .,:;!?()[]{}\" at their ends."""
    listed = F.filter(F.transform(F.split(squashed(text), " "), lambda t: F.lower(F.regexp_replace(t, r"""^[.,:;!?()\[\]{}"]+|[.,:;!?()\[\]{}"]+$""", ""))), lambda t: t != "")
    return let(listed, lambda w: (F.size(w) < 5) | (F.size(F.array_distinct(w)) < F.lit(0.35) * F.size(w)))


def is_generic(text: Column) -> Column:
    """A generic phrase, fewer than five words, or one word in more than 55 of 100 places."""

    def repeated(ordered: Column) -> Column:
        # A word in more than half of all places stands in the middle of the sorted list.
        middle = F.element_at(ordered, F.greatest(F.lit(1), ((F.size(ordered) + 1) / 2).cast("int")))
        most = let(middle, lambda m: F.size(F.filter(ordered, lambda t: t == m)))
        return F.when(F.size(ordered) < 5, True).otherwise(most > F.lit(0.55) * F.size(ordered))

    def decided(plain: Column) -> Column:
        listed = F.filter(F.split(squashed(F.translate(plain, ".,", "  ")), " "), lambda t: t != "")
        return plain.isin(*L.GENERIC_CONTENT) | let(F.array_sort(listed), repeated)

    return let(squashed(F.lower(text_or_empty(text))), decided)


def prefixed_block(text: Column, prefix: str) -> Column:
    """Text after the first ``prefix`` up to the next known one, any case; empty without the prefix."""

    def cut(plain: Column) -> Column:
        at = F.instr(F.lower(plain), prefix.lower())
        rest = F.substr(plain, at + len(prefix))

        def up_to_next(tail: Column) -> Column:
            low = F.lower(tail)
            ends = [F.when(F.instr(low, p.lower()) > 0, F.instr(low, p.lower()) - 1) for p in L.BLOCK_PREFIXES]
            return F.trim(F.substr(tail, F.lit(1), F.coalesce(F.least(*ends), F.length(tail))))

        return F.when(at > 0, let(rest, up_to_next)).otherwise("")

    return let(squashed(text), cut)


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value (two-product, so that no decimal detour is taken)."""
    k = float(10**digits)
    p = value * k
    c = value * 134217729.0
    high = c - (c - value)
    low = value - high
    err = (high * k - p) + low * k
    f = F.floor(p).cast("double")
    half = p - f
    even = F.when(f % 2 == 0, f).otherwise(f + 1)
    whole = F.when(half < 0.5, f).when(half > 0.5, f + 1).when(err < 0, f).when(err > 0, f + 1).otherwise(even)
    return whole / k


def clamped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def utc_time(text: Column) -> Column:
    """Timestamp of an ISO text with or without a zone, UTC without; null if it is none."""
    plain = F.trim(text)
    return F.when(F.rlike(plain, F.lit(r"(Z|[+-]\d\d:?\d\d)$")), plain).otherwise(F.concat(plain, F.lit("Z"))).try_cast("timestamp")


def merged(left: Column, right: Column) -> Column:
    """Entries of two maps; of a key that both have the right one's.  A null map has none."""
    none = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(left, none), F.coalesce(right, none)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of all objects in order and without blanks; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))
