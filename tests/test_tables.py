import pandas as pd
import pytest
from pyspark.sql import functions as F

from columnwright.operators import columns, knowledge, profile, ranks, splits

SEAS = {("Elbe",): "North Sea", ("Ebro",): "Mediterranean", ("Oder",): "Baltic"}


def test_rivers_get_their_seas(spark):
    names = ["Ebro", "Oder", "Elbe", "Ebro", "Ebro", "Nile", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(names)], "id int, river string")
    seas = knowledge.map_values(df, ["river"], knowledge.mapping_frame(df, ["river"], SEAS), "sea")
    assert [r["sea"] for r in seas.orderBy("id").collect()] == ["Mediterranean", "Baltic", "North Sea", "Mediterranean", "Mediterranean", None, None]


def test_composite_keys_match_missing_parts(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], "k string, n int")
    mapping = knowledge.mapping_frame(df, ["k", "n"], {("a", 1): 1.5, ("a", None): 2.5})
    out = knowledge.map_values(df, ["k", "n"], mapping, "v")
    assert {(r["k"], r["n"]): r["v"] for r in out.collect()} == {("a", 1): 1.5, ("a", None): 2.5, (None, 1): None}


def test_ambiguous_lookup_raises(spark):
    df = spark.createDataFrame([("a",)], "k string")
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "k string, value int")
    with pytest.raises(ValueError):
        knowledge.map_values(df, ["k"], twice, "v")


def test_facts_do_not_multiply_rows(spark):
    cars = spark.createDataFrame([("BMW",), ("Audi",), (None,)], "Make string")
    facts = spark.createDataFrame(
        [("BMW", "founder", "Rapp"), ("BMW", "founder", "Castiglioni"), ("BMW", "country", "Germany"),
         ("Fiat", "country", "Italy")], "subject string, relation string, object string")
    out = knowledge.enrich(cars, "Make", facts, ["country", "founder"])
    rows = {r["Make"]: (r["country"], r["country_count"], r["founder"], r["founder_count"]) for r in out.collect()}
    assert rows == {"BMW": ("Germany", 1, "Castiglioni", 2), "Audi": (None,) * 4, None: (None,) * 4}
    assert {r[0] for r in knowledge.query_values(cars, "Make").collect()} == {"BMW", "Audi"}


def test_requests_asked_before_are_left_out(spark):
    kind = "column string, relation string"
    new = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], kind)
    asked = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "z")], kind)
    assert {tuple(r) for r in knowledge.novel_requests(new, asked).collect()} == {("a", "y"), ("b", "x")}


@pytest.mark.parametrize("small_rows", [1_000_000, 10])
def test_percentile_ranks_equal_pandas(spark, small_rows):
    values = [float(i % 37) for i in range(200)] + [None, float("nan"), 1e9] + [5.0] * 100
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    got = [r["r"] for r in ranks.pct_rank(df, "x", "r", small_rows).orderBy("id").collect()]
    want = pd.Series(values, dtype=float).rank(pct=True)
    assert [g is None for g in got] == want.isna().tolist()
    assert [g for g in got if g is not None] == pytest.approx(want.dropna().tolist(), abs=1e-12)


@pytest.mark.parametrize("small_rows", [1_000_000, 5])
def test_category_codes_equal_pandas(spark, small_rows):
    values = [f"w{i * 7 % 23}" for i in range(100)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, c string")
    got = [r["k"] for r in ranks.category_codes(df, "c", "k", small_rows=small_rows).orderBy("id").collect()]
    assert got == pd.Categorical(values).codes.tolist()


def test_codes_per_fold_hide_unseen_values(spark):
    rows = [(0, "a", 0), (1, "a", 1), (2, "b", 0), (3, "b", 0), (4, None, 1), (5, "c", 1)]
    df = spark.createDataFrame(rows, "id int, c string, fold int")
    got = [r["k"] for r in ranks.category_codes_per_fold(df, "c", "k").orderBy("id").collect()]
    assert got == [0, 0, -1, -1, -1, -1]


def test_group_statistics(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", None), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = ranks.group_transform(df, ["k"], F.avg("v"), "m")
    assert sorted(map(str, [(r["k"], r["m"]) for r in out.collect()])) == sorted(
        map(str, [("a", 2.0), ("a", 2.0), ("b", None), (None, None)]))


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "x"), (2, float("nan"), "y"), (None, 4.0, None), (2, float("inf"), "x")], "a int, b double, c string")
    rows = {r["column"]: r for r in profile.profile(df).collect()}
    assert [(rows[c]["dtype"], rows[c]["unique_count"], rows[c]["missing_values"]) for c in "abc"] == [
        ("int", 2, 1), ("double", 2, 2), ("string", 2, 1)]
    assert rows["a"]["unique_values"] == [profile.CONTINUOUS] and rows["c"]["unique_values"] == ["x", "y"]
    assert rows["b"]["mean"] == 2.5 and rows["b"]["min"] == 1.0 and rows["b"]["max"] == 4.0
    assert rows["b"]["std"] == pytest.approx(pd.Series([1.0, 4.0]).std())
    assert rows["c"]["mean"] is None
    near = {r["column"]: r["unique_count"] for r in profile.profile(df, exact=False).collect()}
    assert near == {"a": 2, "b": 2, "c": 2}


def test_profile_of_an_empty_table(spark):
    rows = profile.profile(spark.createDataFrame([], "a int, c string")).collect()
    assert {(r["column"], r["unique_count"], r["missing_values"]) for r in rows} == {("a", 0, 0), ("c", 0, 0)}


def test_profile_json_writes_null(spark):
    df = spark.createDataFrame([("x",)], "c string")
    out = profile.profile_json(profile.profile(df), ["column", "mean"]).first()["profile"]
    assert out == '[{"column":"c","mean":null}]'


def test_value_lists_take_the_most_frequent(spark):
    df = spark.createDataFrame([(c,) for c in "aabbbcd"], "c string")
    assert profile.value_lists(df, ["c"], 2).first()["unique_values"] == ["a", "b"]
    assert profile.value_lists(df, ["c"], None).first()["unique_values"] == ["a", "b", "c", "d"]


def test_projections(spark):
    df = spark.createDataFrame([(1, "a", 2.0, "yes")], "id int, c string, x double, y string")
    features, labels = columns.xy_split(df, ["id"], "y")
    assert features.columns == ["id", "c", "x"] and labels.columns == ["id", "y"]
    assert columns.project_selected(df, ["id"], ["x"], "y").columns == ["id", "x", "y"]
    with pytest.raises(ValueError):
        columns.project_selected(df, ["id"], ["z"], "y")
    assert columns.select_by_type(df).columns == ["id", "x"]
    assert columns.select_by_type(df, numeric=False).columns == ["c", "y"]
    assert columns.feature_columns(df, ["id"], "y") == ["c", "x"]
    assert columns.binary_label(df, "y", "yes").first()["y"] == 1
    assert columns.prune_accept(["a", "b"], ["a"]) and not columns.prune_accept(["a"], ["a"])
    assert not columns.prune_accept(["a", "b"], ["c"])


def test_value_lists_hold_all_values_or_raise(spark):
    df = spark.range(150).selectExpr("CAST(id AS string) AS c")
    found = profile.profile(df).first()
    assert found["unique_count"] == 150 and len(found["unique_values"]) == 150
    with pytest.raises(ValueError):
        profile.value_lists(df, ["c"], list_bytes=100)


def test_a_list_too_big_leaves_the_rest_of_the_profile(spark):
    df = spark.range(150).selectExpr("id", "CAST(id AS string) AS c", "CAST(id % 3 AS string) AS d", "CAST(NULL AS string) AS e")
    rows = {r["column"]: r for r in profile.profile(df, list_bytes=100).collect()}
    assert rows["c"]["unique_values"] is None and rows["c"]["list_omitted"] and rows["c"]["unique_count"] == 150
    assert rows["d"]["unique_values"] == ["0", "1", "2"] and rows["e"]["unique_values"] == []
    assert rows["id"]["mean"] == 74.5 and not any(rows[c]["list_omitted"] for c in ("id", "d", "e"))


def test_profile_counts_make_no_lists(spark, monkeypatch):
    monkeypatch.setattr(profile, "_values", None)
    df = spark.createDataFrame([("x", 1), ("y", None)], "c string, a int")
    assert {(r["column"], r["unique_count"], r["missing_values"]) for r in profile.profile_counts(df).collect()} == {
        ("c", 2, 0), ("a", 1, 1)}


@pytest.mark.parametrize("leaf_values", [10_000, 3])
@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 1.0])
def test_quantile_of_each_group(spark, leaf_values, p):
    """One group holds half of the rows; hot values, huge and tiny numbers, gaps, missing keys."""
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [("big", float(x)) for x in rng.normal(size=300)] + [("hot", 7.0)] * 100 + [("hot", float(x)) for x in range(9)]
    rows += [("wide", float(x)) for x in (-1.7e308, 1.7e308, 1e-300, -1e-300, 0.0, -0.0, 5.0)] + [("one", 4.0), ("none", None)]
    rows += [("gap", x) for x in (1.0, None, float("nan"), float("inf"), 2.0)] + [(None, 1.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, v double, i int")
    got = {r["k"]: r["quantile"] for r in ranks.group_quantiles(df, ["k"], "v", p, leaf_values).collect()}
    assert set(got) == {"big", "hot", "wide", "one", "gap"}
    for k in got:
        own = [v for g, v in rows if g == k and v is not None and np.isfinite(v)]
        assert got[k] == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12), k
    out = ranks.group_quantile(df, ["k"], "v", p, "q", leaf_values)
    assert out.count() == len(rows) and out.where("k IS NULL OR k = 'none'").where("q IS NOT NULL").count() == 0
