"""Words of texts and min-wise signatures of their word sets, by Arrow batch.

A word is a maximal run of letters and digits of the lower-cased text.  The
signature of a set of words has ``FUNCTIONS`` min-wise values; everything that
the near-duplicate operators compare is cut from them:

* ``bits``  - one bit per function, packed into ``FUNCTIONS / 64`` integers.
  Two sets with overlap J agree in a bit with probability (1 + J) / 2, so the
  Hamming distance of two fingerprints estimates the overlap.
* ``codes`` - the low bits of single values, from which sorted signature
  orders are built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Min-wise functions per signature.
FUNCTIONS = 256
#: The same words for the JVM (used where candidate texts are verified).
WORD_PATTERN = r"[\p{L}\p{N}]+"


def words_column(text: Column) -> Column:
    """Distinct words of a text as an array; null text has none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0)))


def _constants(seed: int = 20_011) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**62, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, FUNCTIONS, dtype=np.uint64)


_A, _B = _constants()


def word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: word numbers, first position per text, hash per word number.

    The position array has one entry more than there are texts.
    """
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+")
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    flat = split.flatten().dictionary_encode()
    vocabulary = flat.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    size = max(1, len(vocabulary))
    document = np.repeat(np.arange(len(split), dtype=np.int64), np.diff(np.asarray(split.offsets)))
    number = np.asarray(flat.indices).astype(np.int64)
    if "" in vocabulary:  # a text that begins or ends with a separator
        keep = number != vocabulary.index("")
        document, number = document[keep], number[keep]
    pair = np.sort(document * size + number)
    if len(pair):
        pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))]
    starts = np.searchsorted(pair, np.arange(len(split) + 1, dtype=np.int64) * size)
    return pair % size, starts, hashes


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def set_hashes(numbers: np.ndarray, starts: np.ndarray, hashes: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, independent of order.  Of a text without words: of the text itself."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        mixed = _mix(hashes ^ np.uint64(salt))[numbers] if len(numbers) else np.zeros(0, np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
        out.append(_mix(total[starts[1:]] - total[starts[:-1]] + np.uint64(salt)))
    for i in np.flatnonzero(np.diff(starts) == 0):
        h = xxhash.xxh3_128_intdigest(texts[int(i)].as_py() or "")
        out[0][i], out[1][i] = h & (2**64 - 1), h >> 64
    return out[0].view(np.int64), out[1].view(np.int64)


def signatures(numbers: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Min-wise values, one row per text; a text without words has the largest value everywhere."""
    n = len(starts) - 1
    out = np.full((FUNCTIONS, n), np.iinfo(np.uint32).max, np.uint32)
    some = np.flatnonzero(np.diff(starts) > 0)
    if len(some):
        at, h = starts[some], hashes
        for p in range(FUNCTIONS):
            value = ((h * _A[p] + _B[p]) >> np.uint64(32)).astype(np.uint32)
            out[p, some] = np.minimum.reduceat(value[numbers], at)
    return np.ascontiguousarray(out.T)


def fingerprints(values: np.ndarray) -> np.ndarray:
    """One bit per function as 64-bit integers, FUNCTIONS / 64 per text."""
    bits = ((values >> np.uint32(7)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)
