import random

import pytest

from sievewright.llm.bpe import TOKENIZERS, Encoder, PerfectHash, encoder
from sievewright.llm.encode import encode
from sievewright.llm.token_budget import token_totals

TEXTS = [
    None, "", " ", "\n\n\n", "  a\r\n\t b", "it's we'll'd", "<|endoftext|> <|x|>", "é" * 700, "x" * 5_000, "漢字🚗💧" * 9, " " * 300, "a" + "́" * 40, "naïve café №½", "Тест 123,45", "def f(x):\n    return x",
]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    made.encode_special_tokens = True
    return made


def test_ids_are_the_librarys(spark, library):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumnRenamed("doc_id", "k")
    got = {r.k: list(r.ids) for r in encode(frame, "k").collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(TEXTS)}
    assert encode(frame.limit(0), "k").count() == 0


def test_random_texts(library):
    r, made = random.Random(2), encoder()
    for _ in range(400):
        text = "".join(r.choice("abcdefghij xyz ABC 012 .,!\n\téüжіґ漢🍇́ ") for _ in range(r.randrange(50)))
        assert made.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_round_trip():
    made = encoder()
    back = {v: k for k, v in made.ranks.items()}
    for text in TEXTS:
        assert b"".join(back[i] for i in made.encode([text])[0]).decode() == (text or "")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1_000])
def test_perfect_hash_is_minimal(n):
    keys = [f"key{i}".encode() for i in range(n)]
    table = PerfectHash(keys)
    assert table.find(keys).tolist() == list(range(n))
    assert sorted(table.key_at.tolist()) == list(range(n))


def test_merging_is_by_rank():
    made = Encoder({b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 5})
    assert made.merge(b"abcab") == (5, 4)  # bc, then ab, then a + bc
    assert made.merge(b"cab") == (2, 4)
    assert made.encode(["abc"]) == [[5]]


def test_totals_equal_sums_over_texts(spark, library):
    rows = [(("s1", "s2")[i % 2], t, "x") for i, t in enumerate(TEXTS * 3)]
    frame = spark.createDataFrame(rows, "source string, text string, piece string").repartition(3)
    want = {}
    for s, t, _ in rows:
        n, m, k = want.get(s, (0, 0, 0))
        want[s] = (n + 1, m + bool(t), k + (len(library.encode(t, add_special_tokens=False).ids) if t else 0))
    got = {r.source: (r.rows, r.rows_with_text, r.tokens) for r in token_totals(frame, ["source"]).collect()}
    assert got == want
    assert token_totals(frame.limit(0), ["source"]).count() == 0
