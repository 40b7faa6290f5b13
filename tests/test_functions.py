import pytest
from pyspark.sql import functions as F

from columnwright.functions import binning, missing, rules, text
from columnwright.functions.hashing import hash_uniform

INF, NAN = float("inf"), float("nan")


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(x,) for x in [-1.0, 0.0, 0.5, 1.0, 2.0, 2.5, None]], "x double").coalesce(1)


def test_bin_edges_are_closed_on_the_right(numbers):
    x = F.col("x")
    assert column(numbers, binning.bin_edges(x, [0, 1, 2], ["a", "b"])) == [None, None, "a", "a", "b", None, None]
    lowest = binning.bin_edges(x, [0, 1, 2], ["a", "b"], include_lowest=True)
    assert column(numbers, lowest) == [None, "a", "a", "a", "b", None, None]
    with pytest.raises(ValueError):
        binning.bin_edges(x, [0, 1], ["a", "b"])
    with pytest.raises(ValueError):
        binning.bin_edges(x, [1, 0], ["a"])


def test_equal_width(numbers):
    assert column(numbers, binning.bin_equal_width(F.col("x"), -1.0, 2.5, 7)) == [0, 1, 2, 3, 5, 6, None]
    assert column(numbers, binning.bin_equal_width(F.col("x"), 3.0, 3.0, 4))[-2:] == [1, None]


def test_fixed_width(spark):
    scores = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 5.5, -1)], "s double").coalesce(1)
    assert column(scores, binning.bin_fixed_width(F.col("s"), 3)) == [0.0, 0.0, 3.0, 3.0, -3.0]
    for size in (0, -1, INF, NAN):
        with pytest.raises(ValueError):
            binning.bin_fixed_width(F.col("s"), size)


def test_flags_are_never_missing(spark):
    df = spark.createDataFrame([(20, 1.0), (20, None), (None, 1.0), (30, 1.0)], "a int, b double").coalesce(1)
    both = rules.flag_conjunction([F.col("a") < 25, F.col("b") < 2])
    assert column(df, both) == [1, 0, 0, 0]
    assert column(df, missing.negate(F.col("a") < 25)) == [False, False, True, True]


def test_rules_take_the_first_match(spark):
    df = spark.range(4).coalesce(1)
    out = rules.case_rules([(F.col("id") > 2, F.lit("high")), (F.col("id") > 0, F.lit("some"))])
    assert column(df, out) == [None, "some", "some", "high"]
    assert column(df, rules.interaction_threshold(F.col("id"), 1, F.col("id") * 10)) == [0, 0, 20, 30]


def test_infinities_and_nan_are_missing(spark):
    df = spark.createDataFrame([(1, INF, "x"), (2, -INF, None), (3, NAN, "z"), (None, 4.0, "w")], "a int, b double, c string")
    assert [tuple(r) for r in missing.inf_to_null(df).collect()] == [
        (1, None, "x"), (2, None, None), (3, None, "z"), (None, 4.0, "w")]
    assert [tuple(r) for r in missing.impute_zero(df).collect()] == [
        (1, 0.0, "x"), (2, 0.0, None), (3, 0.0, "z"), (0, 4.0, "w")]


def test_first_class_in_a_reply(spark):
    df = spark.createDataFrame(
        [("It is Neutral, not positive",), ("POSITIVE!",), ("no idea",), (None,)], "r string").coalesce(1)
    classes = ["positive", "neutral"]
    assert column(df, text.label_first_occurrence(F.col("r"), classes)) == ["neutral", "positive", None, None]


def test_marked_class(spark):
    df = spark.createDataFrame(
        [("a <c>\n Yes </c> <c>no</c>",), ("<c></c>",), ("plain",), (None,)], "r string").coalesce(1)
    assert column(df, text.label_marker(F.col("r"), "<c>", "</c>")) == ["yes", None, None, None]


def test_templates(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    out = text.render_template('{{"a": {a}, "b": {b}}}', {"a": F.col("a"), "b": F.col("b")})
    assert column(df, out) == ['{"a": 1, "b": null}']
    with pytest.raises(KeyError):
        text.render_template("{c}", {})


def test_bytes_are_decoded(spark):
    df = spark.createDataFrame([(bytearray("é".encode()), 1)], "a binary, b int")
    assert text.decode_binary_columns(df).first()["a"] == "é"


def test_hash_noise_is_uniform(spark):
    row = spark.range(20_000).select(hash_uniform(["id"], "n").alias("u")).agg(F.min("u"), F.avg("u"), F.max("u")).first()
    assert 0 <= row[0] < 0.01 and abs(row[1] - 0.5) < 0.01 and 0.99 < row[2] < 1
