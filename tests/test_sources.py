import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from columnwright.sources import arff, records, sinks
from columnwright.storage import fresh_path, shared_folder, store

ARFF = """% 1. Title: cars
   % indented
%% twice %
@RELATION cars

@attribute 'make of car' {bmw, 'fi at'}
@attribute price REAL
@attribute "n" INTEGER
@attribute note string
@data
bmw, 1.5, 2, 'it''s'
% in between
'fi at', ?, 3, 'a, b'

?,7,?,?
"""


@pytest.fixture
def cars(tmp_path):
    path = tmp_path / "cars.arff"
    path.write_text(ARFF.replace("it''s", "it\\'s"))
    return str(path)


def test_arff_table(spark, cars):
    df = arff.read_arff(spark, cars)
    assert df.dtypes == [("make of car", "string"), ("price", "double"), ("n", "double"), ("note", "string")]
    assert [tuple(r) for r in df.collect()] == [
        ("bmw", 1.5, 2.0, "it's"), ("fi at", None, 3.0, "a, b"), (None, 7.0, None, None)]


def test_arff_comments_in_order(spark, cars):
    assert arff.comments_text(spark, cars) == "1. Title: cars\n% indented\ntwice %\nin between"


def test_bad_arff_raises(spark, tmp_path):
    path = tmp_path / "bad.arff"
    path.write_text("@relation a\n@attribute x numeric\n@data\nnot a number\n")
    with pytest.raises(PySparkException):
        arff.read_arff(spark, str(path)).collect()
    path.write_text("@data\n1\n")
    with pytest.raises(ValueError):
        arff.read_arff(spark, str(path))


def test_headers_of_all_files_are_compared(spark, tmp_path):
    for name, columns, row in (("one", "ab", "1,2"), ("two", "ba", "3,4")):
        lines = ["@relation t", *[f"@attribute {c} numeric" for c in columns], "@data", row]
        (tmp_path / f"{name}.arff").write_text("\n".join(lines) + "\n")
    with pytest.raises(ValueError, match="different headers"):
        arff.read_arff(spark, str(tmp_path))
    lines = ["@RELATION t", "@attribute   a numeric", "@attribute b real", "@data", "3,4"]
    (tmp_path / "two.arff").write_text("\n".join(lines) + "\n")
    assert sorted(tuple(r) for r in arff.read_arff(spark, str(tmp_path)).collect()) == [(1.0, 2.0), (3.0, 4.0)]


def test_arff_round_trip(spark, tmp_path):
    rows = [(1, "plain", 0.5), (2, "it's, \\ odd", None), (3, None, -1e-9), (4, "?", 1e20), (5, "%x", 0.0)]
    df = spark.createDataFrame(rows, "id int, `a name` string, x double").repartition(3)
    path = str(tmp_path / "out")
    sinks.write_arff(df, "my table", path, ["one", "two"])
    back = arff.read_arff(spark, path)
    assert sorted(tuple(r) for r in back.collect() if r["id"] != 4) == sorted(
        (float(i), s, x) for i, s, x in rows if i != 4)
    assert arff.comments_text(spark, path) == "one\ntwo"
    broken = spark.createDataFrame([("a\nb",)], "s string")
    with pytest.raises(PySparkException):
        sinks.write_arff(broken, "t", str(tmp_path / "broken"))


def test_suggestions(spark):
    reply = '{"columns": [{"name": "a", "generation_method": "x"}, {"name": "b"}]}'
    out = records.suggestions(spark.createDataFrame([(1, reply)], "id int, r string"), "r", ["id"])
    assert [(r["id"], r["position"], r["name"], r["generation_method"]) for r in out.collect()] == [
        (1, 0, "a", "x"), (1, 1, "b", None)]
    with pytest.raises((PySparkException, Py4JJavaError)):
        records.suggestions(spark.createDataFrame([("not json",)], "r string"), "r").collect()


def test_contexts_requests_and_bindings(spark):
    frame = lambda text: spark.createDataFrame([(text,)], "r string")
    context = '{"primary_domain": "cars", "column_descriptions": {"a": "b"}, "important_metadata": "m"}'
    assert tuple(records.domain_contexts(frame(context), "r").first()) == ("cars", {"a": "b"}, "m")
    request = '{"prompt": "p", "column": "c", "relation": "r"}'
    assert tuple(records.kg_requests(frame(request), "r").first()) == ("p", "c", "r")
    answer = ('{"results": {"bindings": [{"x": {"type": "uri", "value": "1"}, "y": {"type": "literal", "value": "2"}},'
              ' {"x": {"type": "uri", "value": "3"}}]}}')
    rows = records.kg_bindings(frame(answer), "r", ["x", "y"]).collect()
    assert [tuple(r) for r in rows] == [("1", "2"), ("3", None)]


def test_ledger_and_selected_append(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i in range(2):
        sinks.append_ledger(sinks.ledger_row(spark, {"round": i, "status": "kept", "selected": ["a"]}), path)
    assert sorted(r["round"] for r in sinks.read_ledger(spark, path).collect()) == [0, 1]
    path = str(tmp_path / "selected")
    sinks.append_selected(spark.createDataFrame([(0, 0, "a")], "split int, position int, feature string"), path)
    sinks.append_selected(spark.createDataFrame([(1, 0, "b")], "split int, position int, feature string"), path)
    assert sinks.read_selected(spark, path).count() == 2
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(1), str(tmp_path / "x"), "other")


def test_stored_tables_live_in_the_shared_folder(spark):
    kept = store(spark.range(10).selectExpr("id", "id % 2 AS y"), "t")
    assert kept.path.startswith(shared_folder(spark).rstrip("/"))
    assert kept.df.where("y = 1").count() == 5
    kept.drop()
    assert fresh_path(spark, "t") != fresh_path(spark, "t")
