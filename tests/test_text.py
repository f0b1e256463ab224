import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.functions import text as T


def one(spark, column, **values):
    names = list(values)
    types = {str: "string", int: "bigint", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{n} {types[type(values[n])]}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("Python python tests lint code code code", ["code", "python", "lint", "tests"]), (None, []), ("the a of", [])],
)
def test_top_keywords(spark, text, want):
    assert one(spark, T.top_keywords(F.col("t"), 4), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("document indexing retrieval notes", ["documents", "document", "search", "retrieval"]), ("unclear broad task", ["general"]), ("nothing here", ["general"]), (None, ["general"]), ("python firewall", ["code", "cybersecurity"])],
)
def test_domains(spark, text, want):
    assert one(spark, T.domains_of(T.terms(F.col("t"))), t=text) == want


def test_normalizing(spark):
    assert one(spark, T.normalized(F.col("t")), t="  Python, tests!!   and LINT checks.  ") == "python tests and lint checks"
    assert one(spark, T.normalized_list(F.col("t")), t=["Python", "tests!", "tests", "!"]) == ["python", "tests"]
    assert one(spark, T.squashed(F.col("t")), t=" a b\x1c\t c\r\n") == "a b c"
    assert one(spark, T.squashed(F.col("t")), t=None) == ""


@pytest.mark.parametrize(("text", "want"), [("notes are available", -1), ("safe mode works", 1), ("unsafe", -1), ("plain", 0), ("", 0)])
def test_polarity(spark, text, want):
    assert one(spark, T.polarity(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("Write python", "code"), ("A summary please", "summarization"), ("Put a label on it", "classification"), ("Why so", "reasoning"), ("Is it?", "factual_qa"), ("Plain.", "unknown"), (None, "unknown"), ("the latest", "code")],
)
def test_sample_type(spark, text, want):
    assert one(spark, T.sample_type(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("My Data-Set 2!", "my-data-set-2"), ("--", "unknown"), (None, "unknown"), ("Größe", "größe")])
def test_slug(spark, text, want):
    assert one(spark, T.slug(F.col("t")), t=text) == want


@pytest.mark.parametrize(("terms", "want"), [(["coolant", "engine-room", "x1y", "z"], "CoolantEngineRoomX1Y"), ([], "Group")])
def test_titles(spark, terms, want):
    assert one(spark, T.title_from_terms(F.col("t")), t=terms) == want


@pytest.mark.parametrize(("text", "want"), [("todo", True), ("a b c", True), ("go go go stop now", True), ("go stop go stop now", False), (None, True)])
def test_generic(spark, text, want):
    assert one(spark, T.is_generic(F.col("t")), t=text) is want


def test_blocks(spark):
    text = "Instruction: Say hi.\nInput: none Output: Hi there."
    assert one(spark, T.prefixed_block(F.col("t"), "Instruction:"), t=text) == "Say hi."
    assert one(spark, T.prefixed_block(F.col("t"), "Output:"), t=text) == "Hi there."
    assert one(spark, T.prefixed_block(F.col("t"), "assistant:"), t=text) == ""


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-2, 2), min_size=50, max_size=200))
def test_rounding_is_that_of_the_binary_value(spark, values):
    values += [k / 2000 for k in range(1, 80, 2)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.rounded(F.col("v"), 3).alias("r")).collect()
    assert [r.r for r in rows] == [round(r.v, 3) + 0.0 for r in rows]
