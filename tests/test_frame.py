"""The frame layer on literals: order, missing values, names and errors."""

import math

import pytest
from pyspark.sql import functions as F

from quillframe.errors import DataValidationError, InvalidParameterError
from quillframe.operators.frame import Frame
from quillframe.plans import ordering

NAN = float("nan")


def frame(spark, rows, schema, order=("i",)):
    return Frame(spark.createDataFrame(rows, schema), list(order))


def column(f, name):
    return [r[name] for r in f.ordered().collect()]


def test_head_and_tail_beyond_the_end(spark):
    f = frame(spark, [(i,) for i in range(3)], "i int")
    assert sorted(column(f.tail(5), "i")) == [0, 1, 2]
    assert column(f.head(2), "i") == [0, 1]
    with pytest.raises(InvalidParameterError):
        f.head(-1)


def test_null_keys_never_match_but_stay(spark):
    left = frame(spark, [(1, "a"), (None, "b"), (2, "c")], "id int, value string", [])
    right = frame(spark, [(None, 10), (2, 20)], "id int, score int", [])
    rows = {tuple(r) for r in left.join(right, "id", "outer").df.collect()}
    assert rows == {(1, "a", None), (None, "b", None), (2, "c", 20), (None, None, 10)}


def test_nan_keys_match_and_overlaps_get_suffixes(spark):
    left = frame(spark, [(NAN, 10), (1.0, 20)], "id double, x int", [])
    right = frame(spark, [(NAN, 30), (2.0, 40)], "id double, x int", [])
    joined = left.join(right, "id").df
    assert joined.columns == ["id", "x_left", "x_right"]
    assert [(r.x_left, r.x_right) for r in joined.collect()] == [(10, 30)]


def test_sort_puts_nan_then_null_last_both_ways(spark):
    f = frame(spark, [(0, NAN), (1, 2.0), (2, None), (3, 1.0)], "i int, v double")
    assert [r.i for r in f.sort("v").df.collect()] == [3, 1, 0, 2]
    assert [r.i for r in f.sort("v", False).df.collect()] == [1, 3, 0, 2]


def test_cleaning_treats_null_and_nan_alike(spark):
    f = frame(spark, [(0, NAN, "a"), (1, None, None), (2, 3.0, "b")], "i int, v double, s string")
    assert column(f.fillna(0.0), "v") == [0.0, 0.0, 3.0]
    assert column(f.fillna("z"), "s") == ["a", "z", "b"]
    assert column(f.dropna(), "i") == [2]
    assert math.isnan(column(f.clip(0, 1), "v")[0])


def test_duplicates(spark):
    f = frame(spark, [(0, 1, 3), (1, 1, 4), (2, 2, 5)], "i int, a int, b int")
    assert column(f.drop_duplicates(["a"]), "b") == [3, 5]
    assert column(f.drop_duplicates(["a"], "last"), "b") == [4, 5]
    assert column(f.drop_duplicates(["a"], False), "b") == [5]
    assert column(f.duplicated(["a"], False), "duplicated") == [True, True, False]


def test_ranks(spark):
    f = frame(spark, [(i, v) for i, v in enumerate([3.0, 1.0, 2.0, 1.0, None, NAN])], "i int, v double")
    got = lambda m: column(f.rank("v", m), "rank")[:4]
    assert got("average") == [4, 1.5, 3, 1.5]
    assert got("min") == [4, 1, 3, 1]
    assert got("max") == [4, 2, 3, 2]
    assert got("dense") == [3, 1, 2, 1]
    assert got("first") == [4, 1, 3, 2]
    assert column(f.rank("v"), "rank")[4:] == [None, None]
    assert column(f.rank("v", "min", False), "rank")[:4] == [1, 3, 2, 3]


def test_windows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK", 8)  # several chunks even here
    f = frame(spark, [(i, float(i * i)) for i in range(50)], "i int, v double")
    v = [float(i * i) for i in range(50)]
    assert column(f.diff("v", 2), "diff") == [None, None] + [v[i] - v[i - 2] for i in range(2, 50)]
    assert column(f.shift("v", -3), "shifted") == v[3:] + [None] * 3
    assert column(f.rolling_mean("v", 3), "rolling_mean")[:4] == [None, None, 5 / 3, 14 / 3]
    assert column(f.cumsum("v"), "cumsum") == [sum(v[: i + 1]) for i in range(50)]


def test_running_values_keep_nulls_and_nan_poisons(spark):
    f = frame(spark, [(0, 1.0), (1, None), (2, 3.0), (3, NAN), (4, 1.0)], "i int, v double")
    got = column(f.cumsum("v"), "cumsum")
    assert got[:3] == [1.0, None, 4.0]
    assert math.isnan(got[3])
    assert math.isnan(got[4])


def test_pivot_rejects_two_values_for_a_cell(spark):
    f = frame(spark, [(1, 1, 10), (2, 1, 20), (1, 1, 30)], "i int, c int, v int")
    with pytest.raises(Exception, match="several values"):
        f.pivot("i", "c", "v").collect()


def test_errors(spark):
    f = frame(spark, [(1, 2)], "i int, b int")
    with pytest.raises(InvalidParameterError):
        f.drop(["x"])
    with pytest.raises(DataValidationError):
        f.rename({"i": "b"})
    with pytest.raises(DataValidationError):
        f.concat(f.drop(["b"]))


def test_empty_frames(spark):
    f = frame(spark, [], "i int, v double")
    assert f.shape == (0, 2)
    assert column(f.cumsum("v"), "cumsum") == []
    assert column(f.rank("v"), "rank") == []
    assert column(f.diff("v"), "diff") == []
    assert f.describe(["v"]).collect()[0].v == 0


def test_numbering_over_ties_and_nulls(spark):
    rows = [(i, None if i % 4 == 0 else i % 3) for i in range(200)]
    f = spark.createDataFrame(rows, "i int, k int")
    got = [r.i for r in ordering.numbered(f, ["k", "i"], buckets=7).orderBy(ordering.ORD).collect()]
    assert got == [i for i, k in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]


def test_plans_push_filters_and_columns(spark):
    f = Frame(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")).filter(F.col("l_quantity") > 25).select(["l_orderkey"])
    plan = f.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,25.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_columns_as_series_and_arrays(spark):
    f = frame(spark, [(0, 2.0, "b"), (1, NAN, "a"), (2, 4.0, "b")], "i int, v double, s string")
    v = f.get("v")
    assert (v.sum(), v.mean(), v.median(), v.min(), v.max(), len(v)) == (6, 3, 3, 2, 4, 3)
    assert f.get("s").unique() == ["b", "a"]
    assert f.get("i").map(lambda c: c * 2).to_list() == [0, 2, 4]
    assert f.get("i").filter(lambda c: c > 0).head(1) == [1]
    assert f.get("i").sort(False).frame.df.first().i == 2
    assert f.get("i").iloc(1) == 1
    with pytest.raises(IndexError):
        f.get("i").iloc(9)
    rows = f.to_arrays(names=["i", "v"]).to_rows()
    assert rows[0] == (0, [0.0, 2.0])
    back = Frame.from_arrays(f.to_arrays(names=["i", "v"]).df, "v", 2, order=["i"])
    assert back.columns == ["i", "col0", "col1"]
    assert "v" in f.text()
    with pytest.raises(DataValidationError):
        f.set_index("s")
    assert f.set_index("i").order == ["i"]


def test_running_values_of_a_sorted_frame_do_not_sort_it_all_and_find_bounds_once(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 50)
    found = []
    monkeypatch.setattr(ordering, "bounds_of", lambda *a, f=ordering.bounds_of: found.append(a) or f(*a))
    rows = [(i, "abc"[i % 3], i * 37 % 211) for i in range(400)]
    f = Frame(spark.createDataFrame(rows, "k long, name string, v long"), ["k"]).sort(["name", "v"], False).reset_index("at").cumsum("v", "total")
    assert len(found) == 1 and "rangepartitioning" not in f.df._jdf.queryExecution().executedPlan().toString()
    want, total = {}, 0
    placed = sorted(rows, key=lambda r: (-ord(r[1]), -r[2], r[0]))
    for at, (k, _, v) in enumerate(placed):
        total += v
        want[k] = (at, total)
    assert {r.k: (r["at"], r.total) for r in f.df.collect()} == want
