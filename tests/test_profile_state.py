import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from columnwright.operators import profile, profile_state as ps

SCHEMA = "id int, name string, score double, at timestamp, empty string"


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (i, None if i % 7 == 0 else f"n{i % 50}", [1e9 + i % 13, -0.0, 0.0, None, float("nan")][i % 5])
        for i in range(600)
    ]
    made = spark.createDataFrame(rows, "id int, name string, score double")
    return made.withColumn("at", F.timestamp_seconds("id")).withColumn("empty", F.lit(None).cast("string"))


def rows_of(found):
    return {r["column"]: r.asDict() for r in found.collect()}


def same(got, want):
    assert set(got) == set(want)
    for name, row in want.items():
        for c, v in row.items():
            if isinstance(v, float):
                assert math.isclose(got[name][c], v, rel_tol=1e-12), (name, c, got[name][c], v)
            else:
                assert got[name][c] == v, (name, c, got[name][c], v)


def test_parts_combine_to_the_profile_of_the_whole(spark, df):
    """Uneven parts, one of them empty, combined in one go and one after the other."""
    parts = [df.where("id < 5"), df.where("id >= 5 AND id < 400"), df.where("id >= 400"), df.where("false")]
    states = [ps.measure(p) for p in parts]
    want = rows_of(profile.profile_counts(df))
    same(rows_of(ps.finish(ps.combine(states))), want)
    same(rows_of(ps.finish(ps.combine([ps.combine(states[2:]), ps.combine(states[:2])]))), want)
    same(rows_of(ps.finish(ps.measure(df))), want)


def test_parts_on_disk(spark, df, tmp_path):
    path = str(tmp_path / "states")
    ps.write_part(ps.measure(df.where("id < 100")), path, "01")
    ps.write_part(ps.measure(df.where("id < 200")), path, "02")
    ps.write_part(ps.measure(df.where("id >= 100")), path, "02")  # the same part again, put right
    # A writer that was lost after its values: the part is not there yet.
    ps.measure(df).values.write.parquet(f"{path}/values/part=03")
    same(rows_of(ps.finish(ps.read_parts(spark, path))), rows_of(profile.profile_counts(df)))


def test_estimates_are_near(spark, tmp_path):
    big = spark.range(40_000).select("id", F.concat(F.lit("v"), F.col("id") % 9_000).alias("name"))
    path = str(tmp_path / "states")
    for i in range(3):
        ps.write_part(ps.measure(big.where(F.col("id") % 3 == i), exact=False), path, f"p{i}")
    got = rows_of(ps.finish(ps.read_parts(spark, path, exact=False)))
    for name, n in (("id", 40_000), ("name", 9_000)):
        assert abs(got[name]["unique_count"] - n) < 4 * 0.0163 * n
    assert got["id"]["mean"] == pytest.approx(19_999.5) and got["id"]["max"] == 39_999


def test_states_that_do_not_fit(spark, df):
    exact, estimate = ps.measure(df), ps.measure(df, exact=False)
    for states in ([], [exact, estimate]):
        with pytest.raises(ValueError):
            ps.combine(states)
    other = ps.measure(df.withColumn("name", F.col("id")))
    with pytest.raises(PySparkException, match="types differ"):
        ps.finish(ps.combine([exact, other])).collect()
    narrow = ps.finish(ps.combine([ps.measure(df.where("id < 300")), ps.measure(df.where("id >= 300").drop("name"))]))
    found = rows_of(narrow)
    assert found["name"]["missing_values"] == 43 and found["id"]["unique_count"] == 600
    assert rows_of(ps.finish(ps.measure(df.where("false"))))["id"]["mean"] is None
