import pytest
from pyspark.errors import ArithmeticException, PySparkException
from pyspark.sql import functions as F

from columnwright.plans import specs
from columnwright.plans.specs import SpecError, accumulate, apply_specs, spec_at_fault, validate


@pytest.fixture(scope="module")
def people(spark):
    rows = [(25, 30000, 1.0), (30, 45000, 2.5), (35, 60000, 4.0), (40, None, 5.5), (None, 52000, 7.0),
            (22, 20000, None), (60, 90000, 9.0)]
    return spark.createDataFrame(rows, "age int, income int, score double").coalesce(1)


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_declared_binning_and_mapping(spark, people):
    binning = specs.from_declarative(
        {"method": "Binning", "input_columns": ["score"], "output_column": "score_bin", "bin_size": 3})
    assert column(apply_specs(people, [binning]), "score_bin") == [0.0, 0.0, 3.0, 3.0, 6.0, None, 9.0]
    rivers = spark.createDataFrame([("Oder",), ("Nile",)], "river string")
    mapping = specs.from_declarative(
        {"method": "Mapping", "input_columns": ["river"], "output_column": "sea", "bin_size": 0,
         "mapping": {("Oder",): "Baltic"}})
    assert dict(tuple(r) for r in apply_specs(rivers, [mapping]).collect()) == {"Oder": "Baltic", "Nile": None}
    with pytest.raises(SpecError):
        specs.from_declarative({"method": "Other", "input_columns": [], "output_column": "x"})


BATCH = [
    {"name": "risk", "op": "flag_conjunction", "input": [], "args": {"conditions": ["age < 31", "income < 46000"]}},
    {"name": "quarter", "op": "bin_quantile", "input": ["score"], "args": {"labels": ["lo", "hi"]}},
    {"name": "third", "op": "bin_equal_width", "input": ["income"], "args": {"k": 3}},
    {"name": "rank", "op": "pct_rank", "input": ["income"]},
    {"name": "by_risk", "op": "group_transform", "input": ["income"], "args": {"by": ["risk"], "agg": "max"}},
    {"name": "code", "op": "category_codes", "input": ["quarter"]},
    {"name": "who", "op": "case_rules", "input": [],
     "args": {"rules": [["risk = 1", "risky"], ["age > 35", {"column": "quarter"}]], "otherwise": "-"}},
    {"name": "gate", "op": "interaction_threshold", "input": ["age", "score"], "args": {"threshold": 30}},
]


def test_later_specs_may_use_earlier_ones(people):
    out = apply_specs(people, BATCH).toPandas().sort_values(["age", "income"]).reset_index(drop=True)
    assert out["risk"].tolist() == [1, 1, 1, 0, 0, 0, 0]
    assert out["quarter"].tolist() == [None, "lo", "lo", "lo", "hi", "hi", "hi"]
    assert out["by_risk"].tolist() == [45000] * 3 + [90000] * 4
    assert out["code"].tolist() == [-1, 1, 1, 1, 0, 0, 0]
    assert out["who"].tolist() == ["risky"] * 3 + ["-", "hi", "hi", "-"]
    assert out["gate"].tolist()[3:6] == [4.0, 5.5, 9.0]


def test_row_wise_specs_are_one_projection(people):
    plan = apply_specs(people, [BATCH[0], {"name": "b", "op": "expr", "input": [], "args": {"sql": "age * 2"}}])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Project") == 1


@pytest.mark.parametrize("bad", [
    {"op": "expr", "args": {"sql": "no_such + 1"}},
    {"op": "expr", "args": {"sql": "reflect('java.lang.System', 'exit', 1)"}},
    {"op": "expr", "args": {"sql": "Java_Method('a', 'b')"}},
    {"op": "expr", "args": {"sql": "(select max(age) from x)"}},
    {"op": "expr", "args": {"sql": "rand()"}},
    {"op": "expr", "args": {"sql": "exists(table x)"}},
    {"op": "expr", "args": {"sql": "unix_timestamp(now())"}},
    {"op": "expr", "args": {"sql": "sum(age) over ()"}},
    {"op": "expr", "args": {"sql": "explode(array(1, 2))"}},
    {"op": "expr", "args": {"sql": "max(age)"}},
    {"op": "expr", "args": {"sql": "age +"}},
    {"op": "bin_edges", "input": ["nowhere"], "args": {"edges": [0, 1], "labels": ["a"]}},
    {"op": "bin_edges", "input": ["age"], "args": {"edges": [0, 1], "labels": ["a", "b"]}},
    {"op": "bin_quantile", "input": ["one"], "args": {"labels": ["a", "b"]}},
    {"op": "unheard_of"},
])
def test_a_bad_spec_fails_the_batch(people, bad):
    df = people.withColumn("one", F.lit(1))
    with pytest.raises(SpecError):
        apply_specs(df, [BATCH[0], {"name": "n", "input": [], **bad}])


def test_text_in_quotes_is_not_checked(people):
    spec = {"name": "t", "op": "expr", "input": [], "args": {"sql": "concat('select ', cast(age as string))"}}
    assert column(apply_specs(people, [spec]), "t")[0] == "select 25"


def test_taken_names_and_the_target_are_skipped(spark):
    batch = [
        {"name": "a", "op": "expr", "args": {"sql": "x + 1"}},
        {"name": "a", "op": "expr", "args": {"sql": "x + 2"}},
        {"name": "x", "op": "expr", "args": {"sql": "1"}},
        {"name": "b", "op": "expr", "args": {"sql": "class = 1"}},
        {"name": "c", "op": "expr", "args": {"sql": "class_size = 1"}},
        {"name": "d", "op": "pct_rank", "input": ["class"]},
        {"name": "f", "op": "expr", "args": {"sql": "CLASS + x"}},
        {"name": "e", "op": "group_transform", "input": ["x"], "args": {"by": ["class"], "agg": "avg"}},
    ]
    kept, skipped = validate(batch, ["x", "class"], "class")
    assert [(s["name"], s["args"]["sql"]) for s in kept] == [("a", "x + 1"), ("c", "class_size = 1")]
    assert skipped == [("a", "exists"), ("x", "exists"), ("b", "uses_target"), ("d", "uses_target"), ("f", "uses_target"), ("e", "uses_target")]


@pytest.mark.parametrize("args", [
    {"op": "case_where", "args": {"condition": "x > 1", "yes": {"column": "gr\u00f6\u00dfe"}, "no": 0}},
    {"op": "case_rules", "args": {"rules": [["x > 1", 1]], "otherwise": {"column": "Gr\u00f6\u00dfe"}}},
    {"op": "case_rules", "args": {"rules": [["x > 1", {"column": "gr\u00f6\u00dfe"}]]}},
    {"op": "expr", "args": {"sql": "`GR\u00f6\u00dfE` + 1"}},
    {"op": "expr", "args": {"sql": "`gr\u00f6\u00dfe` + 1"}},
    {"op": "flag_conjunction", "args": {"conditions": ["x > 1", "coalesce(`gr\u00f6\u00dfe`, 0) = 1"]}},
])
def test_no_way_to_the_target(spark, args):
    assert validate([{"name": "n", "input": [], **args}], ["x", "gr\u00f6\u00dfe"], "gr\u00f6\u00dfe")[1] == [("n", "uses_target")]


@pytest.mark.parametrize("args", [
    {"op": "expr", "args": {"sql": "struct(*)"}},
    {"op": "expr", "args": {"sql": "hash(*)"}},
    {"op": "case_where", "args": {"condition": "true", "yes": {"column": "`age`"}, "no": 0}},
    {"op": "group_transform", "input": ["income"], "args": {"by": ["`age`"], "agg": "avg"}},
    {"op": "expr", "args": {"sql": "concat(r'\\', reflect('java.lang.System', 'lineSeparator'), r'\\')"}},
    {"op": "expr", "args": {"sql": "uniform(0, 1)"}},
    {"op": "expr", "args": {"sql": "randstr(5)"}},
    {"op": "expr", "args": {"sql": "unix_timestamp()"}},
    {"op": "expr", "args": {"sql": "current_user"}},
    {"op": "expr", "args": {"sql": "current_date"}},
    {"op": "expr", "args": {"sql": "json_tuple('{}', 'a')"}},
])
def test_expressions_stay_in_the_row(people, args):
    with pytest.raises(SpecError):
        apply_specs(people, [{"name": "n", "input": [], **args}])


def test_common_expressions_are_allowed(people):
    sql = ("CASE WHEN age BETWEEN 20 AND 30 AND score IS NOT NULL THEN upper(trim('a')) "
           "WHEN age IN (35, 40) OR NOT (income > 1) THEN substring('xyz', 1, 2) ELSE cast(-age % 7 AS string) END")
    out = apply_specs(people, [{"name": "n", "op": "expr", "input": [], "args": {"sql": sql}}])
    assert column(out, "n") == ["A", "A", "xy", "xy", None, "-1", "-4"]


def test_case_does_not_tell_names_apart(spark):
    make = lambda name: {"name": name, "op": "expr", "input": [], "args": {"sql": "x"}}
    kept, skipped = validate([make("Quality"), make("a"), make("A"), make("__fold")], ["x", "quality"])
    assert [s["name"] for s in kept] == ["a"]
    assert skipped == [("Quality", "exists"), ("A", "exists"), ("__fold", "reserved")]


@pytest.mark.parametrize("bad", [None, "text", {}, {"name": "a"}, {"name": 1, "op": "expr"},
                                 {"name": "a", "op": "expr", "input": "x"}, {"name": "a", "op": "expr", "args": "x"}])
def test_what_is_no_spec_raises(bad):
    with pytest.raises(SpecError):
        validate([bad], ["x"])


def test_latest_round_wins_and_earlier_values_stay(spark):
    make = lambda name, sql: {"name": name, "op": "expr", "input": [], "args": {"sql": sql}}
    rounds = [
        [make("a", "x + 1"), make("y", "a + 100")], [make("a", "x * 1000"), make("base", "0")],
        [make("b", "a + 1"), {"name": "y2", "op": "pct_rank", "input": ["x"]}], [make("Y2", "b * 2"), make("c", "b")],
    ]
    df = spark.createDataFrame([(5, 7)], "x int, base int")
    row = accumulate(df, rounds).first().asDict()
    assert row == {"x": 5, "base": 7, "y": 106, "a": 5000, "b": 5001, "Y2": 10002, "c": 5001}


def test_only_specs_and_values_are_spec_at_fault():
    assert spec_at_fault(SpecError("x")) and spec_at_fault(ArithmeticException("x"))
    assert spec_at_fault(PySparkException("Caused by: org.apache.spark.SparkArithmeticException: [DIVIDE_BY_ZERO]"))
    assert not spec_at_fault(PySparkException("ExecutorLostFailure (executor 3 exited)")) and not spec_at_fault(KeyError("x"))


def test_suggestion_rows(spark):
    rows = [
        (0, "a", "df['a'] = df['x'] / df['y']"), (1, "a", "df['a'] = pd.cut(df['x'], 4)"),
        (2, "x", "df['x'] = 1"), (3, "b", "df['b'] = df['class'] > 1"), (4, "c", "df['c'] = df['class_size']"),
        (5, "d", None),
    ]
    df = spark.createDataFrame(rows, "position int, name string, generation_method string")
    out = {r["position"]: (r["status"], r["plain_arithmetic"]) for r in specs.validate_suggestions(df, ["x"], "class").collect()}
    assert out == {0: ("ok", True), 1: ("exists", False), 2: ("exists", False), 3: ("uses_target", False),
                   4: ("ok", False), 5: ("ok", False)}


def test_median_of_a_group_is_a_spec(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 5.0), (3, "a", 6.0), (4, "b", 2.0)], "id int, g string, x double")
    specs = [
        {"name": "mid", "op": "group_transform", "input": ["x"], "args": {"by": ["g"], "agg": "median"}},
        {"name": "low", "op": "group_transform", "input": ["x"], "args": {"by": ["g"], "agg": "quantile", "p": 0.25}},
    ]
    got = {r["id"]: (r["mid"], r["low"]) for r in apply_specs(df, specs).collect()}
    assert got == {1: (5.0, 3.0), 2: (5.0, 3.0), 3: (5.0, 3.0), 4: (2.0, 2.0)}
    for args in ({"by": ["g"], "agg": "quantile", "p": 2}, {"by": ["g"], "agg": "quantile"}, {"by": ["nope"], "agg": "median"}):
        with pytest.raises(SpecError):
            apply_specs(df, [{"name": "bad", "op": "group_transform", "input": ["x"], "args": args}])
    with pytest.raises(SpecError):
        apply_specs(df, [{"name": "bad", "op": "group_transform", "input": ["g"], "args": {"by": ["x"], "agg": "median"}}])
