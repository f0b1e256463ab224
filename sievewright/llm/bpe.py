"""Byte-level BPE with a public vocabulary: a minimal perfect hash for pieces that
are in it, merging over linked bytes with a heap for those that are not."""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import regex
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession

#: Folder of the public tokenizers' files; every function takes another.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: pre-splitting pattern of the vocabulary (byte_bpe_*).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a task keeps; beyond, it forgets them and starts again.
KEPT = 400_000


def read_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Ids by byte string, from a file of base64 strings and ids."""
    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        return {base64.b64decode(piece): int(number) for piece, number in (line.split() for line in file if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings (hash and displace): one slot per key, no empty slot.

    Buckets are placed from the largest; a bucket of one key is sent straight to a free slot.
    Looking up a string that is no key gives some slot: compare its key.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.m = len(keys), max(1, len(keys) // 4)
        bucket, start = self._hashes(keys)
        order = np.argsort(bucket, kind="stable")
        begin = np.searchsorted(bucket[order], np.arange(self.m + 1))
        size = np.diff(begin)
        self.shift = np.zeros(self.m, np.int64)
        self.key_at = np.full(self.n, -1, np.int64)
        tries = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-size, kind="stable"):
            own = order[begin[b] : begin[b + 1]]
            if len(own) < 2:
                break
            base = 0
            while True:
                slots = self._slots(start[own][None, :], (np.uint64(base) + tries)[:, None])
                ok = (self.key_at[slots] < 0).all(axis=1)
                ordered = np.sort(slots, axis=1)
                ok &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if ok.any():
                    t = int(np.argmax(ok))
                    self.shift[b] = base + int(tries[t])
                    self.key_at[slots[t]] = own
                    break
                base += len(tries)
        free = np.flatnonzero(self.key_at < 0)
        single = np.flatnonzero(size == 1)
        self.shift[single] = -1 - free
        self.key_at[free] = order[begin[single]]

    def _hashes(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        wide = [xxhash.xxh3_128_intdigest(k) for k in keys]
        low = np.fromiter((w & 0xFFFFFFFFFFFFFFFF for w in wide), np.uint64, len(wide))
        return (low % np.uint64(self.m)).astype(np.int64), np.fromiter((w >> 64 for w in wide), np.uint64, len(wide))

    def _slots(self, start: np.ndarray, shift: np.ndarray) -> np.ndarray:
        h = start + shift * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((h ^ (h >> np.uint64(29))) % np.uint64(max(1, self.n))).astype(np.int64)

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Number of the key that has each string's slot."""
        bucket, start = self._hashes(strings)
        shift = self.shift[bucket]
        return self.key_at[np.where(shift < 0, -1 - shift, self._slots(start, shift.astype(np.uint64)))]


class Encoder:
    """Ids of texts.  Text that looks like a special token is plain text; null and empty texts have no ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.keys = list(ranks)
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.table = PerfectHash(self.keys)
        self.known: dict[str, tuple[int, ...]] = {}
        self.split = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "split": None}

    def pieces(self, text: str | None) -> list[str]:
        """The text cut by the tokenizer's pattern."""
        if self.split is None:
            self.split = regex.compile(PATTERN).findall
        return self.split(text) if text else []

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece that is not in the vocabulary: the pair of lowest rank is joined, leftmost first, till none is left."""
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.ranks.get, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                joined = part[i] + part[j]
                r = rank(joined)
                if r is not None:
                    heapq.heappush(heap, (r, i, len(joined)))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, length = heapq.heappop(heap)
            if part[i] is None or after[i] >= n or len(part[i]) + len(part[after[i]]) != length:
                continue
            j = after[i]
            part[i], part[j] = part[i] + part[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(self.ranks[p] for p in part if p is not None)

    def learn(self, pieces: set[str]) -> None:
        """Resolve pieces that are not known yet: those of the vocabulary all at once, the others by merging."""
        if len(self.known) > KEPT:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        coded = [p.encode("utf-8", "surrogatepass") for p in new]
        for p, b, k in zip(new, coded, self.table.find(coded).tolist(), strict=True):
            self.known[p] = (int(self.ids[k]),) if self.keys[k] == b else self.merge(b)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pieces(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        known = self.known
        return [list(chain.from_iterable(map(known.__getitem__, c))) for c in cut]


_made: dict[tuple[str, str], Encoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """The encoder of a vocabulary, made once per driver."""
    if (name, folder) not in _made:
        _made[name, folder] = Encoder(read_ranks(name, folder))
    return _made[name, folder]


def shipped(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Broadcast:
    """The encoder for ``opened`` on executors: its size is that of the vocabulary, its code travels with it."""
    return spark.sparkContext.broadcast({"pickled": cloudpickle.dumps(encoder(name, folder))})


def opened(shared: Broadcast) -> Encoder:
    """The shipped encoder, unpacked once per Python worker."""
    held = shared.value
    if "encoder" not in held:
        held["encoder"] = cloudpickle.loads(held["pickled"])
    return held["encoder"]
