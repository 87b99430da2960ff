"""Expression trees, pipes and selection."""

import numpy as np
import pytest

import verbena as v
from verbena import Fx, _
from verbena import expr as E
from verbena.tidyselect import select


def test_trees_are_built_and_shown():
    assert repr(_.a + _["b"] * 2) == "__add__(_.a, __mul__(_['b'], 2))"
    assert repr(1 - _.a.mean(skip=1)) == "__sub__(1, _.a.mean(skip=1))"
    assert repr(np.sqrt(_.x)) == "numpy.sqrt(_.x)"
    assert repr(v.lead(_.x, n=2)) == "lead(_.x, n=2)"
    assert repr(~~_.x) == "_.x" and isinstance(~~_.x, v.Symbolic)


def test_names():
    assert E.simple_name(_.x) == E.simple_name(_["x"]) == E.simple_name("x") == "x"
    assert E.simple_name(_.x + 1) is None and E.simple_name(_.x.y) is None
    assert E.columns_used(_.a + _["b"].mean() + v.coalesce(_.c, 1)) == {"a", "b", "c"}


def test_no_truth_value_and_no_iteration():
    with pytest.raises(TypeError):
        bool(_.x == 1)
    with pytest.raises(TypeError):
        list(_.x)


def test_explain(capsys):
    v.explain(_.x + 1)
    assert capsys.readouterr().out.split() == ["Op", "__add__", "Attr", "x", "Root", "_"]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame([(1, 2.0, "s", True, 5)], "a_x long, a_y double, b_x string, flag boolean, z int")


@pytest.mark.parametrize("args, want", [
    ((_.a_x, "z"), ["a_x", "z"]),
    ((-_.a_x,), ["a_y", "b_x", "flag", "z"]),
    ((_["a_y":"flag"],), ["a_y", "b_x", "flag"]),
    ((_[1:3],), ["a_y", "b_x"]),
    ((_[_.a_y :],), ["a_y", "b_x", "flag", "z"]),
    ((0, -1), ["a_x", "z"]),
    ((_["z", "a_x"],), ["z", "a_x"]),
    ((_.startswith("a_"), -_.a_y), ["a_x"]),
    ((~_.endswith("_x"),), ["a_y", "flag", "z"]),
    ((_.contains("^a|z$"),), ["a_x", "a_y", "z"]),
    ((v.where("number"),), ["a_x", "a_y", "z"]),
    ((lambda n: n == "flag",), ["flag"]),
    ((-_["a_x":"b_x"],), ["flag", "z"]),
])
def test_selection(wide, args, want):
    assert [o for o, _n in select(wide, *args)] == want


def test_selection_renames_and_errors(wide):
    assert select(wide, _.new == _.a_x, _.z) == [("a_x", "new"), ("z", "z")]
    with pytest.raises(KeyError):
        select(wide, _.nope)
    with pytest.raises(TypeError):
        select(wide, v.where(lambda t: 1))


def test_pipes(wide):
    step = v.select(_.a_x) >> v.mutate(y=_.a_x + 1)
    assert (wide >> step).columns == ["a_x", "y"]
    assert v.pipe(wide, step).columns == step(wide).columns == (v.tbl(wide) >> v.call(lambda k, d: d >> step, 1, _)).columns
    assert v.mutate(_, y=1).run(wide).columns[-1] == "y"
    with pytest.raises(TypeError):
        [1, 2] >> v.head(1)
    with pytest.raises(NotImplementedError):
        v.tbl(3)


def test_table_and_preview(spark, wide):
    wide.createOrReplaceTempView("wide_view")
    assert v.tbl(spark, "wide_view", columns=["z"]).columns == ["z"]
    assert "(grouped data frame)" in repr(v.tbl(wide) >> v.group_by(_.z))
    assert "a_x" in (v.tbl(wide))._repr_html_()


def test_unknown_columns_are_named(wide):
    with pytest.raises(AttributeError, match="nope"):
        wide >> v.mutate(y=_.nope + 1)
    with pytest.raises(v.TranslationError, match="Fx"):
        wide >> v.mutate(y=Fx + 1)
