"""Small literal tables with known results."""

from datetime import datetime

import pytest

from lattica.config import Agg, ConfigError, Filter, Having, Limit, ViewConfig
from lattica.operators import dates
from lattica.table import table

DATA = [{"x": 1, "y": "a", "z": True}, {"x": 2, "y": "b", "z": False}, {"x": 3, "y": "c", "z": True}, {"x": 4, "y": "d", "z": False}]
NULLS = [{"x": 3, "y": 1}, {"x": 2, "y": 1}, {"x": None, "y": 1}, {"x": None, "y": 1}, {"x": 4, "y": 2}, {"x": None, "y": 2}]


def tree(t, agg, key="y", **options):
    rows = t.view(row_pivots=[key], aggregates={"v": agg}, **options).to_json()
    return {(r["level"], r[key]): r["v"] for r in rows}


def test_pivot_sum(spark):
    assert tree(table(spark, DATA), Agg("sum", "x"), "z") == {(0, None): 10, (1, False): 6, (1, True): 4}


def test_mean_and_sum_skip_nulls(spark):
    t = table(spark, NULLS)
    assert tree(t, Agg("mean", "x")) == {(0, None): 3.0, (1, 1): 2.5, (1, 2): 4.0}
    assert tree(t, Agg("sum", "x")) == {(0, None): 9, (1, 1): 5, (1, 2): 4}
    assert tree(t, Agg("median", "x")) == {(0, None): 2, (1, 1): 2, (1, 2): 4}
    assert tree(t, Agg("distinct count", "x"))[0, None] == 4
    assert tree(t, Agg("dominant", "x"))[1, 2] is None  # a lone null goes before a lone value


def test_null_is_a_group_of_its_own(spark):
    t = table(spark, [{"x": 1, "y": "x"}, {"x": 1, "y": "y"}, {"x": 1, "y": None}])
    assert tree(t, Agg("count", "x")) == {(0, None): 3, (1, None): 1, (1, "x"): 1, (1, "y"): 1}


def test_group_of_only_nulls_sums_to_zero(spark):
    assert tree(table(spark, NULLS + [{"x": None, "y": 3}]), Agg("sum", "x"))[1, 3] == 0


def test_weighted_mean_sum_abs_any_and(spark):
    t = table(spark, [{"k": 1, "y": 200, "w": 1, "g": "a"}, {"k": 2, "y": 100, "w": 2, "g": "a"}, {"k": 3, "y": -5, "w": 0, "g": "b"}], index="k")
    v = t.view(ViewConfig(row_pivots=("g",), key="k", aggregates={"w": Agg("weighted mean", "y", by="w"), "s": Agg("sum abs", "y"), "any": Agg("any", "w"), "last": Agg("last", "y"), "all": Agg("and", "w")}))
    got = {r["g"]: r for r in v.to_json()}
    assert got["a"]["w"] == pytest.approx(400 / 3) and got["b"]["w"] is None
    assert got[None]["s"] == 305 and got["b"]["any"] == 0 and got["a"]["last"] == 100 and got["b"]["all"] is False


def test_filters_and_nulls(spark):
    t = table(spark, NULLS)
    n = lambda *f: t.view(filters=[f]).num_rows()
    assert n("x", "<", 4) == 2 and n("x", ">", 2) == 2 and n("x", ">", None) == 6 and n("x", "!=", 3) == 5 and n("x", "not in", [3]) == 2


def test_unknown_options_are_errors(spark):
    t = table(spark, DATA)
    for bad in ({"nope": 1}, {"filters": [("x", "like", 1)]}, {"aggregates": {"v": Agg("mode", "x")}}, {"sort": [("x", "down")]}, {"filter_op": "xor"}):
        with pytest.raises(ConfigError):
            t.view(**bad)
    with pytest.raises(ConfigError):
        t.view(row_pivots=["z"], aggregates={"v": Agg("any", "x")}).to_df()
    assert t.is_valid_filter(Filter("x", "<", 1)) and not t.is_valid_filter(Filter("x", "<", None)) and not t.is_valid_filter(Filter("q", "<", 1))


def test_having_and_limit_change_totals(spark):
    t = table(spark, [{"a": "p", "b": 1, "v": 5}, {"a": "p", "b": 2, "v": 1}, {"a": "q", "b": 1, "v": 2}, {"a": None, "b": 3, "v": 9}])
    base = ViewConfig(row_pivots=("a", "b"), aggregates={"v": Agg("sum", "v")})
    got = {(r["level"], r["a"], r["b"]): r["v"] for r in t.view(base.changed(havings=(Having("v", ">", 1, 2),))).to_json()}
    assert got[0, None, None] == 16 and got[1, "p", None] == 5 and (2, "p", 2) not in got and got[1, None, None] == 9
    got = {(r["level"], r["a"], r["b"]): r["v"] for r in t.view(base.changed(limits=(Limit(1, "v", 1),))).to_json()}
    assert got == {(0, None, None): 9, (1, None, None): 9, (2, None, 3): 9}


def test_two_sided_and_columns(spark):
    t = table(spark, DATA)
    v = t.view(row_pivots=["y"], column_pivots=["z"], aggregates={"x": Agg("sum", "x")})
    got = {(r["y"], r["z"], r["row_level"], r["col_level"]): r["x"] for r in v.to_json()}
    assert v.sides == 2 and got[None, None, 0, 0] == 10 and got["a", True, 1, 1] == 1 and got[None, False, 0, 1] == 6


def test_expand_pages_and_window(spark):
    t = table(spark, DATA)
    v = t.view(row_pivots=["z", "y"], aggregates={"x": Agg("sum", "x")})
    assert v.num_rows() == 7 and v.set_depth(1).num_rows() == 3 and not v.get_row_expanded(1)
    assert sorted(r["y"] for r in v.children(True).collect()) == ["a", "c"]
    page = t.view(sort=[("x", "desc")], key="x", items_per_page=3, page_num=2)
    assert [r["x"] for r in page.to_json()] == [1]
    assert page.update_pagination_setting(2, 1).num_rows() == 2
    flat = t.view(sort=[("x", "asc")], key="x")
    assert flat.to_columns(start_row=1, end_row=3, end_col=2) == {"x": [2, 3], "y": ["b", "c"]}
    assert flat.to_csv().splitlines()[:2] == ["x,y,z", "1,a,True"] and flat.to_arrow().num_rows == 4 and flat.col_to_array("x").tolist() == [1, 2, 3, 4]


def test_relative_dates():
    now = datetime(2024, 2, 29, 5)  # a Thursday
    r = lambda op: tuple(str(x) for x in dates.named_range(op, now))
    assert r("this week") == ("2024-02-25", "2024-03-03") and r("last month") == ("2024-01-01", "2024-02-01") and r("last quarter") == ("2023-10-01", "2024-01-01") and r("year to date") == ("2024-01-01", "2024-03-01")
    assert tuple(str(x) for x in dates.relative_range("next", 2, "years", now)) == ("2025-01-01", "2027-01-01")
    assert tuple(str(x) for x in dates.relative_range("previous", 3, "weeks", now)) == ("2024-02-04", "2024-02-25")
    assert str(dates.previous_start("last 7 days", now)) == "2024-02-15"


def test_computed_and_udf(spark):
    t = table(spark, DATA).add_computed(w='"x" * 2 + 1', u=lambda df: df.x + 100)
    assert t.schema()["w"] == "float" and [r["w"] for r in t.view(columns=["w"], sort=[("x", "asc")]).to_json()] == [3.0, 5.0, 7.0, 9.0]
    assert table(spark, DATA).computed_schema(k='length("y")') == {"k": "integer"} and "sqrt" in t.get_computed_functions()


def test_cancel_and_progress(spark):
    import time

    from pyspark.sql import functions as F

    from lattica.plans.jobs import Run

    assert Run(spark, lambda: spark.range(1000).count()).wait(60) == 1000
    slow = Run(spark, lambda: spark.range(0, 10**13, 1, 4).select(F.sum(F.sqrt("id"))).collect())
    time.sleep(3)
    assert slow.progress() < 1
    slow.cancel()
    with pytest.raises(Exception, match="(?i)cancel"):
        slow.wait(60)


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    import __spark_entry__

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())))"], cwd=__spark_entry__.__file__.rsplit("/", 1)[0], capture_output=True, text=True)
    n, odd = map(int, said.stdout.split())
    assert n > 200 and odd == 0
